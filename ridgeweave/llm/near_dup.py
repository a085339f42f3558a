"""Near-duplicates by an LSH forest of MinHash signatures.

Documents with the same shingle set form a class, which its smallest doc_id
represents. A signature has one byte for each of ``places`` hash functions.
Every tree of the forest is a sorted order of the classes by its own sequence
of signature places. A region is what agrees on a tree's first ``least``
places. Within a region the classes that stand next to each other share the
longest prefixes, so the depth at which candidates meet follows the region's
density: each class is a candidate with its ``near`` neighbours on both sides.
A sorted order is cut anywhere into tasks, also inside a region, so a region
of any size is spread over as many tasks as its rows need, and candidates grow
with the rows.

Candidates whose signatures make the least similarity all but impossible go
(six standard errors); the others are confirmed on full sets, and the links
give first components. What neighbours alone can miss is then settled exactly.
Every class of a region that still holds several components takes part in a
join on its rarest shingles: two sets of the least similarity share one of
them. Within the join a pair has to lie in different components and to pass
bounds on size, on the place of the shared shingle, and on the difference of
parity sketches, none of which can lose a link. What passes is confirmed on
full sets, and its links contract the first components. So the only pairs
that can be lost are those that share no region in any tree, or that six
standard errors cut off.

Sets hold 64-bit hashes of shingles. Defined results: a null, empty or
wordless text has no shingles and is linked with nothing; a text of fewer
words than a shingle is one shingle; rows with one doc_id are one document,
which every one of their texts links; a row without doc_id has no component
and is kept; an empty table gives no rows; further columns pass through
``keep_first``. Ties between neighbours in an order go by id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.operators.components import components
from ridgeweave.scratch import Scratch

#: Counters of the shingle frequencies that order shingles by rarity; any order is right, so collisions only cost time.
COUNTERS = 1 << 18
#: 64-bit words of a parity sketch.
SKETCH = 8
PAIR, MEMBER = 0, 1
U = np.uint64


@dataclass(frozen=True)
class Forest:
    """``words`` in a shingle, least similarity in ``percent``, signature ``places``, ``trees``, a region's ``least`` depth and the ``most`` places that order a tree, and how many neighbours are ``near``."""

    words: int = 5
    percent: int = 80
    places: int = 128
    trees: int = 48
    least: int = 6
    most: int = 32
    near: int = 1

    def orders(self) -> np.ndarray:
        """Signature places in the order in which each tree looks at them."""
        random = np.random.default_rng(7)
        return np.array([random.permutation(self.places)[: self.most] for _ in range(self.trees)])

    def least_equal(self) -> int:
        """Equal places below which a pair of the least similarity lies six standard errors off."""
        p = self.percent / 100
        return max(0, math.floor(self.places * (p - 6 * math.sqrt(p * (1 - p) / self.places))))

    def least_common(self, sizes: int) -> int:
        """Least common shingles of two sets of so many shingles together."""
        return -(-self.percent * sizes // (100 + self.percent))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxh3_64_intdigest(b" ".join(tokens), 1)], np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = len(each) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed ^= each[k : k + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def signature(shingles: np.ndarray, factors: np.ndarray, step: int = 1024) -> bytes:
    """One byte of each factor's smallest product with a shingle."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, U)
    for at in range(0, len(shingles), step):
        np.minimum(least, (shingles[at : at + step, None] * factors).min(axis=0), out=least)
    return (mixed(least) >> U(56)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, how: Forest) -> DataFrame:
    """(doc_id, n, digest, sig) of each document; no digest if it has no shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(11).integers(0, 1 << 63, how.places, U) * U(2) + U(1)
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), how.words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, factors) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), width) if len(column) else np.empty((0, width), np.uint8)


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def planted(classes: DataFrame, how: Forest) -> DataFrame:
    """(key, id): each class once in each tree; a key is the tree and the places in its order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = how.orders()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sigs = byte_rows(batch.column(1), how.places)
                keys = np.empty((len(sigs), how.trees, 1 + how.most), np.uint8)
                keys[:, :, 0] = np.arange(how.trees)
                keys[:, :, 1:] = sigs[:, orders]
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), how.trees)
                yield pa.RecordBatch.from_arrays([binary_column(keys.reshape(-1, 1 + how.most)), pa.array(ids, pa.int64())], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key binary, id long")


def neighbours(trees: DataFrame, how: Forest) -> DataFrame:
    """(kind, a, b): PAIR of neighbours of a region, and MEMBER b of the region a.

    A task walks through its stretch of the sorted orders. The first and the
    last row of a stretch always count as members, as their company may lie
    beyond; a pair across that border is left to the exact join, which knows
    both as members.
    """
    region = 1 + how.least

    def region_of(keys: np.ndarray) -> np.ndarray:
        return (keys[:, :region].astype(np.int64) << np.arange(8 * (region - 1), -1, -8)).sum(axis=1) if region <= 8 else mixed((keys[:, :region].astype(U) * np.random.default_rng(3).integers(1, 1 << 62, region, U)).sum(axis=1)).view(np.int64)

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.empty((0, 1 + how.most), np.uint8), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(ids)
            keys = np.concatenate((keys, byte_rows(batch.column(0), 1 + how.most)))
            ids = np.concatenate((ids, batch.column(1).to_numpy(zero_copy_only=False)))
            if not old:
                yield rows(MEMBER, region_of(keys[:1]), ids[:1])
            together = (keys[1:, :region] == keys[:-1, :region]).all(axis=1)
            new = np.flatnonzero(together[max(0, old - 1) :]) + max(0, old - 1)
            some = np.unique(np.concatenate((new, new + 1)))
            yield rows(MEMBER, region_of(keys[some]), ids[some])
            run_of = together
            for gap in range(1, how.near + 1):
                if gap > 1:
                    run_of = run_of[:-1] & together[gap - 1 :]
                at = np.flatnonzero(run_of)
                at = at[at + gap >= old]
                yield rows(PAIR, np.minimum(ids[at], ids[at + gap]), np.maximum(ids[at], ids[at + gap]))
            keys, ids = keys[-how.near :].copy(), ids[-how.near :].copy()
        if len(ids):
            yield rows(MEMBER, region_of(keys[-1:]), ids[-1:])

    return trees.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, "kind int, a long, b long")


def likely(pairs: DataFrame, classes: DataFrame, how: Forest) -> DataFrame:
    """Pairs whose sizes and signatures allow the least similarity."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("sig" + x))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = how.least_equal()
        for batch in batches:
            equal = (byte_rows(batch.column(2), how.places) == byte_rows(batch.column(3), how.places)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(equal >= least))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= how.percent * F.greatest("na", "nb"))
    return both.select("a", "b", "siga", "sigb").mapInArrow(run, "a long, b long")


def sets(docs: DataFrame, wanted: DataFrame, how: Forest) -> DataFrame:
    """(id, shingles) of the documents whose id is in ``wanted``; a repeated text once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), how.words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    # Dealt at every size: the wanted ids grow with the documents, so broadcasting them would only do for small tables.
    some = d.join(wanted.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    once = some.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    return once.select("id", "text").mapInArrow(run, "id long, shingles array<long>").filter("size(shingles) > 0")


def confirmed(pairs: DataFrame, full: DataFrame, how: Forest) -> DataFrame:
    """Pairs that are similar enough on full sets."""
    side = lambda x: full.select(F.col("id").alias(x), F.col("shingles").alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.filter(100 * F.col("common") >= how.percent * (F.col("sizes") - F.col("common"))).select("a", "b").distinct()


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component) of the members of regions that hold several components."""
    named = members.join(labels, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    mixed_ = named.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("region")
    return named.join(mixed_, "region").select("id", "component").distinct()


def frequencies(some: DataFrame) -> np.ndarray:
    """How often shingles occur, by their hash modulo COUNTERS: a fixed number of counters, whatever the input."""
    counts = np.zeros(COUNTERS, np.int64)
    got = some.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).cast("int").alias("slot")).count().toArrow()
    counts[got.column("slot").to_numpy()] = got.column("count").to_numpy()
    return counts


POSTING = [("token", pa.int64()), ("id", pa.int64()), ("component", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("front", pa.bool_()), *((f"o{k}", pa.int64()) for k in range(SKETCH))]
POSTING_DDL = "token long, id long, component long, n int, at int, front boolean, " + ", ".join(f"o{k} long" for k in range(SKETCH))


def rarest_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return shingles[np.lexsort((shingles, counts[shingles.view(np.int64) % COUNTERS]))]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Of each of the sketch's bits, whether an odd number of shingles falls on it.

    Two sketches differ in at most as many bits as their sets differ in shingles.
    """
    bit = (mixed(shingles) >> U(40)) % U(64 * SKETCH)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def postings(some: DataFrame, counts: np.ndarray, how: Forest) -> DataFrame:
    """Each set's rarest shingles: those that a smaller set of the least similarity must meet, in front those that a larger one must."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in POSTING]
            for id_, component, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles.values.to_numpy(zero_copy_only=False).view(U)
                n = len(s)
                prefix = rarest_first(s, counts)[: n - -(-how.percent * n // 100) + 1]
                front = n - how.least_common(2 * n) + 1
                m = len(prefix)
                values = (prefix.view(np.int64), np.full(m, id_), np.full(m, component), np.full(m, n), np.arange(m), np.arange(m) < front, *(np.full(m, o) for o in parity_sketch(s)))
                for held, x in zip(columns, values, strict=True):
                    held.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, (_, kind) in zip(columns, POSTING, strict=True)], schema=pa.schema(POSTING))

    return some.select("id", "component", "shingles").mapInArrow(run, POSTING_DDL)


def across(posted: DataFrame, how: Forest) -> DataFrame:
    """Pairs of different components that may reach the least similarity.

    Each shared rare shingle has a main component, its most frequent one.
    Members of that one are never compared with each other: outsiders stand on
    one side of the join, or the main ones face outsiders only.
    """
    share = posted.groupBy("token", "component").count()
    main = share.groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1").select("token", "main")
    posted = posted.join(main, "token").withColumn("outside", F.col("component") != F.col("main"))

    def matched(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in d.columns]) for d, side in ((x, "x"), (y, "y")))
        n, m = F.col("x_n"), F.col("y_n")
        least = F.ceil(F.lit(how.percent) * (n + m) / (100 + how.percent))
        differ = sum((F.bit_count(F.col(f"x_o{k}").bitwiseXOR(F.col(f"y_o{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("x_o0").bitwiseXOR(F.col("y_o0"))))
        bounds = (m <= n) & (100 * m >= how.percent * n) & (F.least(n - F.col("x_at"), m - F.col("y_at")) >= least) & (differ <= n + m - 2 * least)
        return x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_component") != F.col("y_component")) & bounds).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    front, outside = F.col("front"), F.col("outside")
    return matched(posted.filter(outside), posted.filter(front)).union(matched(posted.filter(~outside), posted.filter(front & outside))).distinct()


def one_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between a document and the classes of its texts, where it has several."""
    several = rows.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id")
    return rows.join(several, "doc_id").join(classes.select("digest", "id"), "digest").filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()


def link(docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document."""
    scratch = Scratch(docs.sparkSession, "near_dup")
    rows = scratch.keep(signed(docs, how), "signed")
    known = rows.filter("digest is not null and doc_id is not null")
    classes = scratch.keep(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    walked = scratch.keep(neighbours(planted(classes, how), how), "neighbours")
    members = walked.filter(F.col("kind") == MEMBER).select(F.col("a").alias("region"), F.col("b").alias("id"))
    full = scratch.keep(sets(docs, members, how), "sets")
    pairs = scratch.keep(likely(walked.filter(F.col("kind") == PAIR).select("a", "b").filter("a <> b").distinct(), classes, how), "likely")
    links = scratch.keep(confirmed(pairs, full, how).union(one_document(rows, classes)), "links")
    first = components(links, scratch)

    open_ = undecided(members, first)
    some = scratch.keep(full.join(open_, "id").select("id", "component", "shingles"), "undecided")
    posted = scratch.keep(postings(some, frequencies(some), how), "postings")
    found = scratch.keep(confirmed(scratch.keep(across(posted, how), "across"), full, how), "found")
    of = some.select("id", "component").distinct()
    joined = found.join(of.withColumnRenamed("id", "a"), "a").withColumnRenamed("component", "x").join(of.withColumnRenamed("id", "b"), "b")
    above = components(joined.select(F.col("x").alias("a"), F.col("component").alias("b")), scratch)

    above = above.select(F.col("id").alias("component"), F.col("component").alias("above"))
    of_class = classes.select("digest", "id").join(first, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    of_class = of_class.join(above, "component", "left").select("digest", F.coalesce("above", "component").alias("component"))
    shown = lambda component: ("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    linked = known.select("doc_id", "n", "digest").join(of_class, "digest").select(*shown(F.col("component")))
    return linked.union(rows.filter("digest is null or doc_id is null").select(*shown(F.col("doc_id"))))


def keep_first(docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """One document of each component, with the columns of ``docs``."""
    gone = Scratch(docs.sparkSession, "near_dup").keep(link(docs, how).filter("not kept").select(F.col("doc_id").alias("__near_dup_id")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__near_dup_id"], "left_anti")
