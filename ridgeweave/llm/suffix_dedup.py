"""Removal of long byte strings that a document with a smaller id also holds.

The index is a sparse suffix array. Of the suffixes of a text only those at
anchors are indexed: an anchor is a place whose ``K`` bytes hash lowest among
all such places in some string of ``MATCH`` bytes. Equal strings choose equal
places, so every match of ``MATCH`` bytes contains an anchor that both sides
have, and about one byte in sixteen is one. As only equality counts, suffixes
are ordered by the fingerprint of their first ``K`` bytes and then by two
fingerprints of their context: all bytes of the ``MATCH``-byte strings that
contain the anchor. Both have 64 bits and their own bases and byte values; the
second also holds a sum modulo a prime, so no pair of texts makes both agree
for the same reason.

Each bucket of anchors keeps a logarithmic family of such arrays. A batch
arrives sorted and is merge-scanned against levels that are no larger: where
one suffix of two levels has the context of another, the larger document's is
covered and leaves the index, the smaller one's stays. The merged array is the
new level, and so on up, so levels grow geometrically.

- A context that a smaller document has too is wholly covered.
- An anchor that occurs in different contexts needs a closer look: one suffix
  of each context is looked at string by string, by the same merge scans.

Before any shuffle a task settles what repeats within its own documents and
sends each pair of anchor and context once, so a passage in a third of all
documents costs one entry for each task and not one for each document. A task
works through one bucket after the other, and their number follows the data.

Defined results: a null or empty text has no bytes and keeps the hash of
nothing; rows that share a doc_id never cover each other, and what is removed
from one of them goes by its own text; rows without doc_id neither cover nor
are covered; texts of any length are indexed in overlapping slices; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch

MATCH, K = 50, 20
W = MATCH - K + 1
SIDE = MATCH - K
#: Bytes that are looked at together; longer texts are cut with enough overlap.
SLICE = 1 << 18
#: Entries that a task settles among themselves before it sends them.
HELD = 1 << 19
#: Bytes that the tables of powers serve at least, so slices of any size share one.
LEAST = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64
SPAN, COVERED, CLOSER = 0, 1, 2
#: Bits of an anchor's key that are sent beside its bucket. Keys only gather contexts for the closer look, so two that agree in them cost a look at most.
SENT = (1 << 32) - 1


# -- fingerprints and anchors ---------------------------------------------------


@lru_cache(maxsize=2)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, U)


@lru_cache(maxsize=2)
def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, U(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: An odd modulus whose remainders come from shifts, and the bases of the second print.
PRIME, SECOND, THIRD = (1 << 31) - 1, 0xC2B2AE3D27D4EB4F, 1_220_703_125


def folded(x: np.ndarray) -> np.ndarray:
    """A number of few more bits than PRIME with the remainder of ``x``, which is overwritten."""
    for _ in range(2):
        high = x >> U(31)
        x &= U(PRIME)
        x += high
    return x


def remainder(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME."""
    x = folded(x)
    return np.where(x >= U(PRIME), x - U(PRIME), x)


@lru_cache(maxsize=1)
def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of THIRD and of its inverse modulo PRIME, by doubling."""
    out = []
    for b in (THIRD, pow(THIRD, -1, PRIME)):
        p = np.array([1], U)
        while len(p) <= n:
            p = np.concatenate((p, remainder(p * U(pow(b, len(p), PRIME)))))
        out.append(p[: n + 1])
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def both_prints(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A fingerprint of 64 bits of an anchor, by the bits of its key that are sent, in its context; compared within one document only."""
    return mixed(mixed((key & U(SENT)) ^ U(BASE)) + context)


class Prints:
    """Fingerprints of any substrings of ``data``, from sums over its beginnings."""

    def __init__(self, data: np.ndarray, seed: int = 5, base: int = BASE):
        power, self.inverse = powers(max(LEAST, 1 << int(len(data)).bit_length()), base)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(byte_values(seed)[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def runs(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n else np.empty(0, U)


class Checks:
    """Second fingerprints, which share nothing with the first: a sum with its own base and byte values, mixed with one modulo a prime."""

    def __init__(self, data: np.ndarray):
        self.whole = Prints(data, 6, SECOND)
        power, self.inverse = prime_powers(max(LEAST, 1 << int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(folded((byte_values(7) & U(PRIME))[data] * power[: len(data)]), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        odd = remainder(remainder(self.sums[end] - self.sums[start]) * self.inverse[start])
        return mixed(self.whole.of(start, end) ^ mixed(odd + U(THIRD)))


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, key, context, check, left, right) of the anchors of texts that lie behind one another in ``data``.

    ``left`` and ``right`` bound the context, which never leaves its text.
    """
    none = np.empty(0, np.int64)
    if len(data) < MATCH:
        return none, none.view(U), none.view(U), none.view(U), none, none
    prints = Prints(data)
    keys = prints.runs(K)
    starts = np.concatenate(([0], ends[:-1]))
    low = sliding(keys, W, np.minimum)
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(low)]
    low[np.arange(len(low)) + MATCH > ends[text]] = 0
    edge = np.zeros(W - 1, U)
    high = sliding(np.concatenate((edge, low, edge)), W, np.maximum)
    place = np.flatnonzero((high == keys) & (keys > 0))
    own = np.searchsorted(ends, place, "right")
    left, right = np.maximum(starts[own], place - SIDE), np.minimum(ends[own], place + MATCH)
    check = Checks(data).of(left, right)
    context = prints.of(left, right) + (place - left).astype(U) * U(0xA24BAED4963EE407)
    # chosen keys are low by nature; mixed once more, they spread evenly over the buckets
    return place, mixed(keys[place] ^ U(BASE)), context, check, left, right


def text_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, text, shift): texts gathered up to SLICE bytes; long ones in overlapping parts.

    A part overlaps the next by all that an anchor's context can reach, and
    what an anchor's choice depends on, on either side.
    """
    held, which, shift, size = [], [], [], 0

    def out():
        data = np.frombuffer(b"".join(held), np.uint8)
        return data, np.cumsum([len(x) for x in held]), np.array(which), np.array(shift, np.int64)

    for k, t in enumerate(texts):
        if len(t) < MATCH:
            continue
        for at in range(0, len(t), SLICE):
            part = t[max(0, at - 4 * MATCH) : at + SLICE + 4 * MATCH]
            if len(part) < MATCH:
                continue
            held.append(part)
            which.append(k)
            shift.append(max(0, at - 4 * MATCH))
            size += len(part)
            if size >= SLICE:
                yield out()
                held, which, shift, size = [], [], [], 0
    if held:
        yield out()


def all_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, key, context, check, left, right), places within the text.

    Anchors whose context a cut shortens are left to the neighbouring part.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    for data, ends, which, shift in text_slices(texts):
        place, key, context, check, left, right = anchors(data, ends)
        own = np.searchsorted(ends, place, "right")
        moved = shift[own] - np.concatenate(([0], ends[:-1]))[own]
        text = which[own]
        place, left, right = place + moved, left + moved, right + moved
        whole = (left == np.maximum(0, place - SIDE)) & (right == np.minimum(sizes[text], place + MATCH))
        yield tuple(x[whole] for x in (text, place, key, context, check, left, right))


# -- the family of sorted arrays ------------------------------------------------


class Family:
    """Sorted arrays of geometrically growing size over equal columns.

    The first column orders a level, the next ``names`` name an entry. ``scan``
    looks at a level, or at two merged into one, and says what stays. Entries
    of one name stand together: where two names share a place in the order, it
    is made anew by names.
    """

    def __init__(self, names: int, scan: Callable[[list[np.ndarray]], list[np.ndarray]]) -> None:
        self.levels: list[list[np.ndarray]] = []
        self.names, self.scan = names, scan

    def ordered(self, columns: list[np.ndarray], kind: str = "quicksort") -> list[np.ndarray]:
        order = np.argsort(columns[0], kind=kind)
        level = [c[order] for c in columns]
        tie = level[0][1:] == level[0][:-1]
        if any((c[1:] != c[:-1])[tie].any() for c in level[1 : 1 + self.names]):
            order = np.lexsort((*columns[self.names : 0 : -1], columns[0]))
            level = [c[order] for c in columns]
        return self.scan(level)

    def joined(self, *levels: list[np.ndarray]) -> list[np.ndarray]:
        """The stable sort finds the two sorted runs and merges them."""
        return self.ordered([np.concatenate(x) for x in zip(*levels, strict=True)], "stable")

    def add(self, columns: list[np.ndarray]) -> None:
        level = self.ordered(columns)
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            level = self.joined(self.levels.pop(), level)
        self.levels.append(level)

    def merged(self) -> list[np.ndarray]:
        while len(self.levels) > 1:
            self.levels.append(self.joined(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def narrow(doc: np.ndarray) -> bytes:
    """Documents in four bytes each where they fit, as most do."""
    return doc.astype(np.int32).tobytes() if doc.min() >= -(1 << 31) and doc.max() < 1 << 31 else doc.tobytes()


def widened(doc: bytes, n: int) -> bytes:
    """``n`` documents in eight bytes each, from those of ``narrow``."""
    return doc if len(doc) == 8 * n else np.frombuffer(doc, np.int32).astype(np.int64).tobytes()


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def merge_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of spans, as rows of start and end; touching ones join."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return np.column_stack((start[first], np.append(end[first[1:] - 1], end[-1]))).astype(np.int64)


def runs_of(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the entries that agree in all columns."""
    if not len(columns[0]):
        return
    order = np.lexsort(columns)
    cuts = np.flatnonzero(group_starts(*(c[order] for c in columns)))[1:]
    yield from np.split(order, cuts)


# -- tasks ------------------------------------------------------------------------

#: A row of a document's spans, of entries dealt by bucket, or of flags; ``h`` tells apart the texts of one doc_id.
FLAGS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), *((x, pa.binary()) for x in "abcde")])
FLAGS_DDL = "bucket int, kind int, doc_id long, h long, a binary, b binary, c binary, d binary, e binary"
ENTRIES = 3


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FLAGS, strict=True)], schema=FLAGS)


def batches_of(rows: list[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield batch_of(rows[at : at + size])


def span_rows(doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple]:
    return [(int(doc[p[0]]) % buckets, SPAN, int(doc[p[0]]), int(h[p[0]]), merge_spans(start[p], end[p]).tobytes(), *[None] * 4) for p in runs_of(doc, h)]


def gathered(rows: Iterable[tuple], least: int) -> Iterator[list[bytes]]:
    """The binary columns of rows, joined to batches of ``least`` bytes in the first one."""
    held, size = [], 0
    for row in rows:
        held.append(row[4:])
        size += len(row[4])
        if size >= least:
            yield [b"".join(x) for x in zip(*held, strict=True) if x[0] is not None]
            held, size = [], 0
    if held:
        yield [b"".join(x) for x in zip(*held, strict=True) if x[0] is not None]


def smallest(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry the least value of its run; runs begin at ``new``."""
    return np.minimum.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> U(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(key), np.int64)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so few texts are held as objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in column.to_pylist()]


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]] | pa.RecordBatch]:
    """Batches of spans as they come, and each bucket with its other rows; the input is sorted by bucket."""
    current, rows = None, []
    for batch in sliced(batches, 64):
        spans = pc.equal(batch.column(1), SPAN)
        passed = batch.filter(spans)
        if passed.num_rows:
            yield passed
        rest = batch.filter(pc.invert(spans))
        for row in zip(*(c.to_pylist() for c in rest.columns), strict=True):
            if rows and row[0] != current:
                yield current, iter(rows)
                rows = []
            current = row[0]
            rows.append(row)
    if rows:
        yield current, iter(rows)


def index_task(buckets: int):
    """Documents to entries by bucket, and to spans that the task's own documents settle."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, context, check, doc, h, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((doc, check, context, key))
        key, context, check, doc, h, left, right = (x[order] for x in (key, context, check, doc, h, left, right))
        new = group_starts(key, context, check)
        gone = doc > doc[new][np.cumsum(new) - 1]
        rows = span_rows(doc[gone], h[gone], left[gone], right[gone], buckets)
        key, context, check, doc = key[new], context[new], check[new], doc[new]
        for p in runs_of(bucket_of(key, buckets)):
            p = np.sort(p)
            rows.append((int(bucket_of(key[p[:1]], buckets)[0]), ENTRIES, None, None, key[p].astype(np.uint32).tobytes(), context[p].tobytes(), check[p].tobytes(), narrow(doc[p]), None))
        yield from batches_of(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in sliced(batches):
            ids, hs = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 2))
            for text, _, key, context, check, left, right in all_anchors(text_bytes(batch.column(1))):
                parts.append((key, context, check, ids[text], hs[text], left, right))
                size += len(key)
                if size >= HELD:
                    yield from settle(parts)
                    parts, size = [], 0
        if parts:
            yield from settle(parts)

    return run


def scan_task():
    """Entries of buckets to what is covered and what needs a closer look, by document."""

    def flags(kind: int, doc: np.ndarray, prints: np.ndarray) -> list[tuple]:
        return [(0, kind, int(doc[p[0]]), None, np.unique(prints[p]).tobytes(), *[None] * 4) for p in runs_of(doc)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            covered: list[tuple[np.ndarray, np.ndarray]] = []

            def scan(level: list[np.ndarray]) -> list[np.ndarray]:
                _, key, context, check, doc = level
                new = group_starts(key, context, check)
                least = smallest(doc, new)
                gone = doc > least
                covered.append((doc[gone], both_prints(key[gone], context[gone])))
                stays = [x[new] for x in level]
                stays[4] = least[new]
                return stays

            family = Family(3, scan)
            wide = ((*r[:7], widened(r[7], len(r[4]) // 4), None) for r in found[1])
            for batch in gathered(wide, 1 << 18):
                key, context, check, doc = (np.frombuffer(x, t) for x, t in zip(batch, (np.uint32, U, U, np.int64), strict=True))
                key = key.astype(U)
                family.add([(key << U(32)) | (context >> U(32)), key, context, check, doc])
            _, key, context, _, doc = family.merged()
            rows = flags(COVERED, *(np.concatenate(x) for x in zip(*covered, strict=True)))
            fresh = group_starts(key)
            of_key, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            closer = (np.bincount(of_key) > 1)[of_key] & (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at))[of_key]
            rows += flags(CLOSER, doc[closer], both_prints(key[closer], context[closer]))
            yield from batches_of(rows)

    return run


def apply_task(buckets: int):
    """Documents with their flags to spans, and to contexts by bucket for the closer look."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, hs = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 2))
            texts = text_bytes(batch.column(1))
            flags = [[np.frombuffer(b"".join(x or []), U) for x in batch.column(c).to_pylist()] for c in (3, 4)]
            rows: list[tuple] = []
            for text, _, key, context, _, left, right in all_anchors(texts):
                prints = both_prints(key, context)
                hit = [np.zeros(len(text), bool), np.zeros(len(text), bool)]
                for p in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
                    for k in (0, 1):
                        f = flags[k][text[p[0]]]
                        if len(f):
                            hit[k][p] = np.isin(prints[p], f)
                covered, closer = hit
                rows += span_rows(ids[text[covered]], hs[text[covered]], left[covered], right[covered], buckets)
                which = np.flatnonzero(closer)
                bucket = bucket_of(key[which], buckets)
                for p in runs_of(bucket):
                    w = which[p]
                    data = b"".join([texts[t][s:e] for t, s, e in zip(text[w].tolist(), left[w].tolist(), right[w].tolist(), strict=True)])
                    rows.append((int(bucket[p[0]]), CLOSER, None, None, ids[text[w]].tobytes(), left[w].tobytes(), (right[w] - left[w]).astype(np.uint8).tobytes(), data, hs[text[w]].tobytes()))
            yield from batches_of(rows)

    return run


def closer_task(buckets: int):
    """Contexts of buckets to the spans of their strings that a smaller document has."""

    def strings(ids: np.ndarray, start: np.ndarray, length: np.ndarray, data: bytes, h: np.ndarray) -> list[np.ndarray]:
        body = np.frombuffer(data, np.uint8)
        at = np.cumsum(length) - length
        n = np.maximum(0, length - MATCH + 1)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        s = at[row] + k
        return [Prints(body).of(s, s + MATCH), Checks(body).of(s, s + MATCH), ids[row], h[row], start[row] + k]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            spans: list[tuple[np.ndarray, ...]] = []

            def scan(level: list[np.ndarray]) -> list[np.ndarray]:
                string, check, doc, h, start = level
                gone = doc > smallest(doc, group_starts(string, check))
                spans.append((doc[gone], h[gone], start[gone]))
                return [x[~gone] for x in level]

            family = Family(1, scan)
            for batch in gathered(found[1], 1 << 17):
                a, b, c, d, e = batch
                columns = strings(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.uint8).astype(np.int64), d, np.frombuffer(e, np.int64))
                family.add(columns)
            family.merged()
            doc, h, start = (np.concatenate(x) for x in zip(*spans, strict=True))
            yield from batches_of(span_rows(doc, h, start, start + MATCH, buckets))

    return run


def buckets_for(docs: DataFrame) -> int:
    """A power of two, one bucket for each 2 MB of the input as Spark estimates it, or of its texts where Spark can't."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # Spark's word for an unknown size
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(30, max(6, (size >> 21).bit_length()))


def removed_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, spans): spans that a smaller document covers, in one or several rows for a document's text."""
    known = docs.filter("doc_id is not null and length(text) > 0")
    n = buckets_for(docs)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)
    dealt = lambda df: df.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    flags = scratch.keep(dealt(known.mapInArrow(index_task(n), FLAGS_DDL)).mapInArrow(scan_task(), FLAGS_DDL), "flags")
    of_kind = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("a")))
    wanted = flags.filter(F.col("kind") != SPAN).groupBy("doc_id").agg(of_kind(COVERED).alias("covered"), of_kind(CLOSER).alias("closer"))
    found = dealt(known.join(wanted, "doc_id").select("doc_id", "text", "h", "covered", "closer").mapInArrow(apply_task(n), FLAGS_DDL)).mapInArrow(closer_task(n), FLAGS_DDL)
    found = scratch.keep(found, "spans")
    return flags.filter(F.col("kind") == SPAN).union(found).select("doc_id", "h", F.col("a").alias("spans"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: its bytes, what is removed, and the hash of the rest."""
    scratch = Scratch(docs.sparkSession, "suffix")
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    spans = removed_spans(d, scratch).groupBy("doc_id", "h").agg(F.collect_list("spans").alias("spans"))
    both = d.join(spans, ["doc_id", "h"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rest, gone = kept(text, found)
                rows.append((doc_id, len(text), len(text) - len(rest), gone, hashlib.sha256(rest).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, REPORT)


def kept(text: bytes, found: list[bytes] | None) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs went."""
    if not found:
        return text, 0
    s = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    runs = merge_spans(s[:, 0], s[:, 1])
    cuts = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), len(runs)
