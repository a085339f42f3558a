"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed into buckets. Bucket counts over all
documents and over all target texts give each bucket a gain, and the gains are
one array of fixed size that scores documents where they lie. Adding Gumbel
noise from a hash of the doc_id makes the highest scores a weighted draw
without replacement.

The k-th key of (score, doc_id) is found by radix selection: each round counts
one digit of what is still in question, so at most 2^16 numbers reach the
driver and no row moves. Only rows up to that key are sorted, by range, and
numbered.

Defined results: a null text has no words, weight 0 and no place in the draw
unless the limit of words is 0; a null doc_id hashes as an empty one and comes
after all others of its score; of rows that tie in score and doc_id at the end
of the draw the first few are drawn, so their number is exact; texts of any
length are read whole; empty tables give no rows, and an empty target makes all
gains those of unseen buckets; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeweave.llm.text import LOWER, UPPER
from ridgeweave.operators.paths import with_ordinals
from ridgeweave.scratch import Scratch

DIGIT = 16
#: Words that a task remembers the gain of.
CACHE = 1 << 20
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with at least ``least_words`` words."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def word_bytes() -> bytes:
    """For each byte its lower case where words have it, else a blank."""
    keep = {k: k for k in range(128, 256)} | {ord(c): ord(c) for c in "0123456789" + LOWER} | {ord(u): ord(c) for u, c in zip(UPPER, LOWER, strict=True)}
    return bytes(keep.get(k, 32) for k in range(256))


WORD_BYTES = word_bytes()


def features(text: bytes | None, longest: int) -> tuple[list[bytes], int]:
    """All runs of 1 to ``longest`` words, and how many words there are."""
    words = (text or b"").translate(WORD_BYTES).split()
    if longest == 1:
        return words, len(words)
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def bucket_counts(texts: DataFrame, how: Draw) -> DataFrame:
    """(bucket, n) over all ``texts``; a task sends each bucket once."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(features(text, how.longest)[0])
            if seen:
                at = np.fromiter((zlib.crc32(f) % how.buckets for f in seen), np.int64, len(seen))
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    return texts.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Gain of each bucket, in thousandths of a natural logarithm, rounded down."""
    every, wanted = sum(source.values()) + buckets, sum(target.values()) + buckets
    out = []
    for b in range(buckets):
        t, s = float(target.get(b, 0) + 1), float(source.get(b, 0) + 1)
        out.append(math.floor(1000 * math.log(t * float(every) / (s * float(wanted)))))
    return out


class Gains(dict):
    """Gain of a feature, looked up in the array and remembered."""

    def __init__(self, array: list[int]):
        self.array = array

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[feature] = self.array[zlib.crc32(feature) % len(self.array)]
        return found


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, by a hash of the document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, array: list[int], how: Draw) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Gains(array)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found, n = features(text, how.longest)
                rows.append((len(found), n, sum(map(gain.__getitem__, found)) // len(found) if found else 0))
            cols = zip(*rows, strict=True) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], schema=schema)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = out.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), how.seed))


def radix_select(rows: DataFrame, keys: list[str], k: int, scratch: Scratch, digit: int = DIGIT) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) of the long columns ``keys``, compared in order; None where there are fewer rows.

    Each key is taken as an upper and a lower half, whose differences fit a
    long. A round counts the highest digit in which the remaining rows can
    still differ. Once a key is settled, the rows that share it are written,
    so later rounds read only these.
    """
    left, found = rows.select(*keys), []
    for key in keys:
        halves = []
        for half in (F.shiftright(key, 32), F.col(key).bitwiseAND(F.lit(0xFFFFFFFF))):
            inside = left.select(half.alias("v"), *keys)
            low, high, n = inside.agg(F.min("v"), F.max("v"), F.count("v")).first()
            if k < 1 or n < k:
                return None
            bits = (high - low).bit_length()
            while bits:
                step = max(0, bits - digit)
                counted = inside.filter((F.col("v") >= low) & (F.col("v") - low < 1 << bits)).groupBy(F.shiftright(F.col("v") - low, step).alias("d")).count()
                for d, n in sorted(counted.collect()):
                    if n >= k:
                        low += d << step
                        break
                    k -= n
                bits = step
            halves.append(low)
            left = left.filter(half == low)
        found.append((halves[0] << 32) + halves[1])
        if key != keys[-1]:
            left = scratch.keep(left, "ties")
    return tuple(found)


def draw(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` is null where it isn't drawn."""
    scratch = Scratch(docs.sparkSession, "resample")
    both = [{r["bucket"]: r["n"] for r in bucket_counts(t, how).collect()} for t in (docs, target)]
    rows = scored(docs, gains(*both, how.buckets), how).withColumns({"turned": -F.col("score"), "last": F.coalesce("doc_id", F.lit(MOST))})
    rows = scratch.keep(rows, "scored")
    able = F.col("n_words") >= how.least_words
    most = how.percent * rows.filter(able).count() // 100
    end = radix_select(rows.filter(able), ["turned", "last"], most, scratch)
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if end is None:
        return rows.select(*names, none)
    within = able & ((F.col("turned") < end[0]) | ((F.col("turned") == end[0]) & (F.col("last") <= end[1])))
    ranked = with_ordinals(rows.filter(within), ["turned", "last", "n_features", "weight"])
    rank = F.col("path_ordinal") + 1
    return ranked.select(*names, F.when(rank <= most, rank).cast("long").alias("rank")).unionByName(rows.filter(~within).select(*names, none))


def drawn(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, columns unchanged."""
    chosen = draw(docs, target, how).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
