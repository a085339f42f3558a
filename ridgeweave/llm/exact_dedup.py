"""Exact duplicates by a sort on content.

Runs of white space become one space. Rows are range-partitioned by sampled
splitters and sorted inside each partition, so equal texts lie side by side;
each row is then compared in full with the one before it. The order is that of
a text's first characters, then of its digest, then of its document: keys that
are sampled or compared stay short however long a text is, and a group of
copies of any size is cut over as many partitions as its rows fill.

A run of equal texts is finished where it ends. Only a partition's first and
last run can go on next door; these few are compared in full as well, by a join
of neighbouring partitions, and chained.

Defined results: a null text is empty, and all empty texts are one group; of
rows with the same document and equal texts one stays; a null doc_id comes
after all others, so it stays only where its group has no other; texts of any
length are compared whole; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.llm.text import BLANKS
from ridgeweave.scratch import Scratch

#: Characters of a text that order it before its digest does.
PREFIX = 32
#: Bits of ``edge``: the first and the last run of a partition.
FIRST, LAST = 1, 2
RUNS = pa.schema(
    [("part", pa.int32()), ("edge", pa.int32()), ("lead", pa.bool_()), ("doc_id", pa.int64()), ("least", pa.int64()), ("n", pa.int64()), ("text_sha256", pa.string()), ("edge_text", pa.string())]
)
RUNS_SQL = "part int, edge int, lead boolean, doc_id long, least long, n long, text_sha256 string, edge_text string"


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; empty for a null."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def by_content(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, body), equal bodies side by side and their smallest doc_id first."""
    body = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body, 256).alias("sha"), body.alias("body"))
    order = [F.substring("body", 1, PREFIX), F.col("sha"), F.asc_nulls_last("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class Runs:
    """Runs of equal neighbours in one partition, read batch by batch.

    Only the ids of the run that is still open are held.
    """

    def __init__(self, part: int):
        self.part = part
        self.ids: list[pa.Array] = []
        self.body: str | None = None
        self.sha = ""
        self.closed = 0

    def _batch(self, edge: int, lead: np.ndarray, ids: pa.Array, least: pa.Array, n: np.ndarray, sha: pa.Array, text: pa.Array) -> pa.RecordBatch:
        k = len(ids)
        cols = [pa.array(np.full(k, self.part, np.int32)), pa.array(np.full(k, edge, np.int32)), pa.array(lead), ids, least, pa.array(n, pa.int64()), sha, text]
        return pa.RecordBatch.from_arrays(cols, schema=RUNS)

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The open run, with its text where the run may go on in another partition."""
        edge = (0 if self.closed else FIRST) | (LAST if last else 0)
        self.closed += 1
        total, lead = sum(map(len, self.ids)), True
        least = self.ids[0][:1]
        for ids in self.ids:
            k = len(ids)
            first = np.zeros(k, bool)
            first[0] = lead
            text = pa.concat_arrays([pa.array([self.body if lead and edge else None], pa.string()), pa.nulls(k - 1, pa.string())])
            yield self._batch(edge, first, ids, least.take(pa.array(np.zeros(k, np.int64))), np.full(k, total), pa.array([self.sha] * k, pa.string()), text)
            lead = False
        self.ids = []

    def read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sha, body = batch.columns
        k = len(ids)
        new = np.ones(k, bool)
        new[1:] = ~pc.equal(body.slice(1), body.slice(0, k - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.body is None or body[0].as_py() != self.body
        starts = np.flatnonzero(new)
        if not len(starts):
            self.ids.append(ids)
            return
        if starts[0]:
            self.ids.append(ids.slice(0, starts[0]))
        if self.ids:
            yield from self.close(last=False)
        if len(starts) > 1 and not self.closed:
            self.ids, self.body, self.sha = [ids.slice(starts[0], starts[1] - starts[0])], body[int(starts[0])].as_py(), sha[int(starts[0])].as_py()
            yield from self.close(last=False)
            starts = starts[1:]
        low, high = int(starts[0]), int(starts[-1])
        if high > low:
            size = np.diff(starts)
            least = ids.take(pa.array(np.repeat(starts[:-1], size)))
            yield self._batch(0, new[low:high], ids.slice(low, high - low), least, np.repeat(size, size), sha.slice(low, high - low), pa.nulls(high - low, pa.string()))
            self.closed += len(size)
        self.ids, self.body, self.sha = [ids.slice(high)], body[high].as_py(), sha[high].as_py()


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = Runs(TaskContext.get().partitionId())
    for batch in batches:
        if len(batch):
            yield from state.read(batch)
    if state.ids:
        yield from state.close(last=True)


def chained(rows: DataFrame) -> DataFrame:
    """(part, edge, keep, total, on): what the runs that cross partitions are part of.

    ``rows`` has at most two such runs for each partition. Each partition's
    last text meets the next one's first in a join; windows see numbers only.
    """
    edges = rows.filter((F.col("edge") > 0) & F.col("lead"))
    has = lambda bit: F.col("edge").bitwiseAND(F.lit(bit)) > 0
    place = edges.select("part").distinct().withColumn("k", F.row_number().over(W.orderBy("part")))
    ended = edges.filter(has(LAST)).join(place, "part").select((F.col("k") + 1).alias("k"), F.col("edge_text").alias("before"))
    begun = edges.filter(has(FIRST)).join(place, "part").select("k", "part", "edge", "edge_text")
    going = begun.join(ended, "k").select("part", "edge", (F.col("before") == F.col("edge_text")).alias("on"))
    order = W.orderBy("part", "edge")
    chain = edges.select("part", "edge", "least", "n").join(going, ["part", "edge"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    chain = chain.withColumn("chain", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order))
    every = W.partitionBy("chain").orderBy("part", "edge").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return chain.select("part", "edge", "on", F.first("least").over(every).alias("keep"), F.sum("n").over(every).alias("total"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The table that is broadcast has at most two rows for each partition of the sort.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.keep(by_content(docs).mapInArrow(runs, RUNS_SQL), "runs")
    fixed = scratch.keep(chained(rows), "edges")
    out = rows.drop("edge_text").join(F.broadcast(fixed), ["part", "edge"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("total").isNull(), F.col("least")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        (F.col("lead") & ~F.coalesce("on", F.lit(False))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a kept row has, columns unchanged."""
    names = docs.columns
    rows = docs.withColumn("_sha", F.sha2(normalised(F.col("text")), 256))
    kept = report(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    met = rows.join(kept, (F.col("_sha") == F.col("_kept_sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
    return met.dropDuplicates(["doc_id", "_sha"]).select(*names)
