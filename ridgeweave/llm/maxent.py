"""Language-model scoring: add-one unigrams, and a hashed maximum-entropy model.

Texts become blocks of word numbers, each with its own small vocabulary of
64-bit word hashes, so later passes read numbers and not texts. Counts of all
training words are summed by bucket of the hash and come back to the blocks in
their vocabulary's order; no table of all words is ever in one place.

The model factors a word's probability three times: its class, from its last
letters; its cell within the class, from its hash; and the word within the
cell. Class and cell are softmaxes over hashed features: the two classes
before (class only), the word before, the word before that (a skip), and both
words together; a cell's features are hashed together with the class. Within a
cell, which holds about a five-hundredth of the vocabulary, words have add-one
estimates without context, and a cell's unseen words share one more place.
Weights have a fixed size whatever the corpus. Each round every task takes
gradient steps on every training word of its own blocks, and the tasks'
changes are averaged by examples, slice by slice and in two steps, so no task
reads more than about the square root of all tasks' changes. Scoring gathers
the rows of weights that the features name.

Defined results: a null or empty text is just its end; a null doc_id counts as
empty text for the fold, so it is trained on; repeated rows count as often as
they occur; an empty table, or one without training rows, scores by uniform
classes; a text of any length lies in one block; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch

U = np.uint64
END = 1


@dataclass(frozen=True)
class Shape:
    """``classes`` (the last one is the end), ``cells`` in a class, 2^``bits`` and 2^``cell_bits`` hashed rows, ``rounds`` over every training word, and how they step."""

    classes: int = 32
    cells: int = 16
    bits: int = 14
    cell_bits: int = 15
    rounds: int = 1
    rate: float = 0.3
    batch: int = 1024
    block_bytes: int = 4 << 20

    def rows(self) -> int:
        return self.classes**2 + (1 << self.bits)

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of cells."""
        return np.zeros((self.rows(), self.classes), np.float32), np.zeros((1 << self.cell_bits, self.cells), np.float32)

    def cell(self, vocab: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Numbers of the cells, those of a class together."""
        return classes.astype(np.int64) * self.cells + ((vocab * U(0xA24BAED4963EE407)) >> U(32)).astype(np.int64) % self.cells


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Numbers(dict):
    """Gives a new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "block long, ids array<long>, sizes binary, words binary, vocab binary, classes binary, counts binary"


def blocks(docs: DataFrame, shape: Shape) -> DataFrame:
    """BLOCKS: documents of up to ``block_bytes`` together.

    ``words`` are places in ``vocab``, which is sorted by hash; every document
    ends with the end's place. ``counts`` are those in training documents.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        made = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[list[int]] = []
        names, size = Numbers(), 0

        def out() -> pa.RecordBatch:
            nonlocal ids, parts, names, size, made
            names[b"\n"]  # noqa: B018  the end, which no word equals
            end = names[b"\n"]
            sizes = np.array([len(p) + 1 for p in parts], np.int32)
            local = np.empty(int(sizes.sum()), np.int32)
            at = 0
            for p in parts:
                local[at : at + len(p)] = p
                local[at + len(p)] = end
                at += len(p) + 1
            vocab = np.array([END if w == b"\n" else xxh3_64_intdigest(w) for w in names], U)
            classes = np.array([shape.classes - 1 if w == b"\n" else zlib.crc32(w[-2:]) % (shape.classes - 1) for w in names], np.uint8)
            order = np.argsort(vocab, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            local = place[local]
            train = np.repeat(np.array([not held_out(i) for i in ids]), sizes)
            counts = np.bincount(local[train], minlength=len(order)).astype(np.int64)
            row = (made, ids, sizes.tobytes(), local.tobytes(), vocab[order].tobytes(), classes[order].tobytes(), counts.tobytes())
            ids, parts, names, size, made = [], [], Numbers(), 0, made + 1
            types = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace").lower()
                ids.append(doc_id)
                parts.append(list(map(names.__getitem__, raw.split())))
                size += len(raw)
                if size >= shape.block_bytes:
                    yield out()
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


# -- counts ---------------------------------------------------------------------

COUNTS = "block long, bucket int, vocab binary, classes binary, counts binary"
TOTALS = "block long, bucket int, counts binary, n array<long>, v array<long>"  # n and v by cell


def summed_counts(table: DataFrame, buckets: int, tasks: int, shape: Shape) -> DataFrame:
    """TOTALS: for each block and bucket of its vocabulary the corpus's counts; rows without a block hold totals by cell.

    A task works one bucket at a time, and buckets follow the data, so what it holds does not grow.
    """
    shift = U(64 - (buckets.bit_length() - 1))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v, c, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                vocab, classes, counts = np.frombuffer(v, U), np.frombuffer(c, np.uint8), np.frombuffer(n, np.int64)
                cuts = np.searchsorted(vocab >> shift, np.arange(buckets + 1, dtype=U)) if buckets > 1 else [0, len(vocab)]
                rows = [(block, b, vocab[s].tobytes(), classes[s].tobytes(), counts[s].tobytes()) for b in range(buckets) if (s := slice(cuts[b], cuts[b + 1])) and cuts[b] < cuts[b + 1]]
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "bucket", "vocab", "classes", "counts"])

    def total(b: int, parts: list[tuple]) -> pa.RecordBatch:
        words, first, place = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([p[3] for p in parts]), minlength=len(words)).astype(np.int64)
        cell = shape.cell(words, np.concatenate([p[2] for p in parts])[first])
        rows: list[tuple] = []
        at = 0
        for block, v, _, _ in parts:
            rows.append((block, b, totals[place[at : at + len(v)]].tobytes(), None, None))
            at += len(v)
        most = shape.classes * shape.cells
        rows.append((None, b, None, np.bincount(cell, weights=totals, minlength=most).astype(np.int64).tolist(), np.bincount(cell[totals > 0], minlength=most).tolist()))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "bucket", "counts", "n", "v"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for block, b, v, c, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if parts and b != current:
                    yield total(current, parts)
                    parts = []
                current = b
                parts.append((block, np.frombuffer(v, U), np.frombuffer(c, np.uint8), np.frombuffer(n, np.int64)))
        if parts:
            yield total(current, parts)

    return table.select("block", "vocab", "classes", "counts").mapInArrow(deal, COUNTS).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(add, TOTALS)


# -- the model ------------------------------------------------------------------


def features(vocab: np.ndarray, classes: np.ndarray, words: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Rows of weights for each word: for its class both classes before, the word before, a skip, and both words; for its cell the last three."""
    h, c = vocab[words], classes[words].astype(np.int32)
    end = shape.classes - 1

    def before(x: np.ndarray, k: int, fill) -> np.ndarray:
        out = np.full(len(x), fill, x.dtype)
        out[k:] = x[: len(x) - k]
        for j in range(k):
            at = starts + j
            out[at[at < len(x)]] = fill
        return out

    h1, h2 = before(h, 1, U(END)), before(h, 2, U(END))
    # a document's second word looks back over its start
    c1, c2 = before(c, 1, end), before(c, 2, end)
    named = (h1 * U(0x9E3779B97F4A7C15), h2 * U(0xC2B2AE3D27D4EB4F), (h1 * U(0x165667B19E3779F9)) ^ (h2 * U(0x27D4EB2F165667C5)))
    of_class = (c1 * shape.classes + c2, *((x >> U(64 - shape.bits)).astype(np.int32) + shape.classes**2 for x in named))
    here = c.astype(U) * U(0xD6E8FEB86659FD93)
    return of_class, tuple((((x ^ (x >> U(32))) + here) * U(0xFF51AFD7ED558CCD) >> U(64 - shape.cell_bits)).astype(np.int32) for x in named)


def softmax(weights: np.ndarray, rows: tuple[np.ndarray, ...], bias: np.ndarray) -> np.ndarray:
    """Probabilities, for each row of features; ``bias`` is one row for all, or one for each."""
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    z += bias
    np.clip(z, -60, 60, out=z)  # so no sum of exponentials is nought or infinite
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def summed(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in ``r``, sorted, and for each the sum of its rows of ``g``.

    Most numbers have one row, which is taken as it is; only the others' are added.
    """
    bits = (len(r) - 1).bit_length()
    kind = np.int32 if int(r.max()) < 1 << (31 - bits) else np.int64
    packed = (r.astype(kind) << kind(bits)) | np.arange(len(r), dtype=kind)
    packed.sort()
    by, ordered = packed & kind((1 << bits) - 1), packed >> kind(bits)
    again = ordered[1:] == ordered[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~again)))
    total = g.take(by.take(first), 0)
    if len(first) < len(r):
        among = np.concatenate((again, [False])) | np.concatenate(([False], again))  # has another row of its number
        begins = among.take(first)
        starts = (np.cumsum(among) - 1).take(first[begins])
        total[begins] = np.add.reduceat(g.take(by[among], 0), starts, axis=0)
    return ordered.take(first), total


def step(weights: np.ndarray, squares: np.ndarray, rows: tuple[np.ndarray, ...], bias: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step; each row of weights has its own rate, which falls with its gradients so far."""
    g = softmax(weights, rows, bias)
    g[np.arange(len(g)), target] -= 1
    for r in rows:
        at, total = summed(g, r)
        size = squares.take(at) + (total * total) @ np.ones(total.shape[1], total.dtype)
        squares[at] = size
        total *= (rate / np.sqrt(size))[:, None]
        weights[at] = weights.take(at, 0) - total


def opened(row: dict) -> tuple[np.ndarray, ...]:
    """(sizes, words, vocab, classes) of a block."""
    return np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["words"], np.int32), np.frombuffer(row["vocab"], U), np.frombuffer(row["classes"], np.uint8)


CHANGES = [("slice", pa.int32()), ("part", pa.int32()), ("seen", pa.int64()), ("change", pa.binary())]
CHANGES_DDL = "slice int, part int, seen long, change binary"


def train_round(table: DataFrame, weights: tuple[np.ndarray, np.ndarray], bias: tuple[np.ndarray, np.ndarray], shape: Shape, number: int, slices: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The weights after every task's gradient steps on its blocks, averaged by examples."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((weights, bias))
    parts = max(1, round(table.rdd.getNumPartitions() ** 0.5))

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bias = shared.value
        of_class, of_cell = (w.copy() for w in first)
        squares = [np.full(len(w), 1e-2, np.float32) for w in first]
        seen = 0
        for batch in batches:
            for row in batch.to_pylist():
                sizes, words, vocab, classes = opened(row)
                starts = np.cumsum(sizes) - sizes
                chosen = np.flatnonzero(np.repeat(np.array([not held_out(i) for i in row["ids"]]), sizes))
                if not len(chosen):
                    continue
                both = features(vocab, classes, words, starts, shape)
                cell = shape.cell(vocab, classes)[words]
                kind = classes[words]
                order = np.random.default_rng(row["block"] % (1 << 32) + number).permutation(chosen)
                for at in range(0, len(order), shape.batch):
                    p = order[at : at + shape.batch]
                    step(of_class, squares[0], tuple(x[p] for x in both[0]), bias[0], kind[p], shape.rate)
                    step(of_cell, squares[1], tuple(x[p] for x in both[1]), bias[1][kind[p]], cell[p] % shape.cells, shape.rate)
                seen += len(chosen)
        if seen:
            change = np.concatenate([(w - f).reshape(-1) for w, f in zip((of_class, of_cell), first, strict=True)])
            part = TaskContext.get().partitionId() % parts
            rows = [(k, part, seen, x.astype(np.float32).tobytes()) for k, x in enumerate(np.array_split(change, slices))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), CHANGES, strict=True)], schema=pa.schema(CHANGES))

    def average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for k, part, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = np.frombuffer(x, np.float32).astype(np.float64) * n
                if (k, part) in held:
                    held[k, part][0] += n
                    held[k, part][1] += total
                else:
                    held[k, part] = [n, total]
        rows = [(k, part, n, (x / n).astype(np.float32).tobytes()) for (k, part), (n, x) in sorted(held.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), CHANGES, strict=True)], schema=pa.schema(CHANGES))

    found = table.select("block", "ids", "sizes", "words", "vocab", "classes").mapInArrow(steps, CHANGES_DDL)
    found = found.repartition(slices * parts, "slice", "part").mapInArrow(average, CHANGES_DDL)
    found = found.withColumn("part", F.lit(0)).repartition(slices, "slice").mapInArrow(average, CHANGES_DDL).collect()
    shared.unpersist()
    if not found:
        return weights
    change = np.concatenate([np.frombuffer(r["change"], np.float32) for r in sorted(found, key=lambda r: r["slice"])])
    cut = weights[0].size
    return weights[0] + change[:cut].reshape(weights[0].shape), weights[1] + change[cut:].reshape(weights[1].shape)


REPORT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """REPORT for each document; the scores are log10 probabilities of whole texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    table = scratch.keep(blocks(docs, shape), "blocks")
    n_blocks = table.count()
    buckets = 1 << max(4, (2 * n_blocks).bit_length())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    counts = scratch.keep(summed_counts(table, buckets, tasks, shape), "counts")
    n, v = np.zeros(shape.classes * shape.cells), np.zeros(shape.classes * shape.cells)
    totals = counts.filter("block is null").select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v"))
    for r in totals.collect():  # one row for each cell
        n[r["pos"]], v[r["pos"]] = r["n"], r["v"]
    by_class = n.reshape(shape.classes, shape.cells)
    bias = (
        np.log((by_class.sum(axis=1) + 1) / (n.sum() + shape.classes)).astype(np.float32),
        np.log((by_class + 1) / (by_class.sum(axis=1, keepdims=True) + shape.cells)).astype(np.float32),
    )
    weights = shape.empty()
    for k in range(shape.rounds):
        weights = train_round(table, weights, bias, shape, k)
    shared = spark.sparkContext.broadcast((weights, bias, n, v))
    known = counts.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("known")).select("block", F.col("known.counts").alias("known"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, n, v = shared.value
        total, distinct = float(n.sum()), float(v.sum())
        for batch in batches:
            for row in batch.to_pylist():
                sizes, words, vocab, classes = opened(row)
                starts = np.cumsum(sizes) - sizes
                c = np.frombuffer(b"".join(row["known"]), np.int64)
                base = np.log10(c + 1.0)
                cell = shape.cell(vocab, classes)
                each = (base - np.log10(n + v + 1.0)[cell])[words]
                cell, kind = cell[words], classes[words]
                of_class, of_cell = features(vocab, classes, words, starts, shape)
                for at in range(0, len(words), shape.batch):
                    s = slice(at, at + shape.batch)
                    here = np.arange(len(kind[s]))
                    p = softmax(weights[0], tuple(x[s] for x in of_class), bias[0])[here, kind[s]]
                    q = softmax(weights[1], tuple(x[s] for x in of_cell), bias[1][kind[s]])[here, cell[s] % shape.cells]
                    # a probability that rounds to nothing still counts as the least that a float holds
                    each[s] += np.log10(np.maximum(p, 1e-37)) + np.log10(np.maximum(q, 1e-37))
                by_doc = lambda x: np.add.reduceat(x, starts)
                cols = [
                    pa.array(row["ids"], pa.int64()),
                    pa.array([held_out(i) for i in row["ids"]]),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(by_doc((c > 0).astype(np.int64)[words])),
                    pa.array([int(total)] * len(sizes), pa.int64()),
                    pa.array(by_doc(base[words]) - sizes * np.log10(total + distinct + 1.0)),
                    pa.array(by_doc(each)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in REPORT.split(", ")])

    return table.drop("counts").join(known, "block").select("ids", "sizes", "words", "vocab", "classes", "known").mapInArrow(run, REPORT)
