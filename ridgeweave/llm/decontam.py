"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` consecutive words, or the whole
item if it is shorter. A window holds a text's run only if all its shingles
occur there, so its rarest shingle in the corpus is a sufficient prefix. The
join is on that shingle alone; where it occurs, the window's place follows
from the shingle's place in the window (positional bound), must lie inside the
text (length bound), and is then compared word by word.

Defined results: a null or wordless text has no words and is clean; an item
without words has no windows; items with a null id mark words but aren't
counted; rows that repeat an id are each compared with their own words; empty
tables are allowed on either side; further columns pass through ``mark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeweave.llm import text as T
from ridgeweave.scratch import Scratch

WINDOW, SHINGLE = 10, 5
P = "__decontam_"


def item_words(text: Column) -> Column:
    return T.words(T.lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), T.NO_LETTERS)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``words``, and ``items`` as strings."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    runs = F.when(F.size("words") <= window, F.array("words")).otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)), lambda i: F.slice("words", i, F.lit(window))))
    return w.select("item", F.explode(runs).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def shingles(words: Column, sizes: list[int]) -> Column:
    """(size, place, hash) of each shingle of the given sizes."""

    def tagged(n: int) -> Column:
        return F.transform(T.shingle_hashes(words, n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("at"), h.alias("h")))

    by_size = [tagged(n) for n in sizes]
    return by_size[0] if len(by_size) == 1 else F.concat(*by_size)


def candidates(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, found): for each document the windows that its prefix shingles point to.

    The benchmark's side of either join is a written table, whose size Spark
    knows: it is broadcast below Spark's own threshold and shuffled beyond it.
    """
    w = scratch.keep(windows(benchmark, window).withColumn("n", F.least(F.size("words"), F.lit(shingle))), "windows")
    sizes = sorted(r[0] for r in w.select("n").distinct().collect()) or [shingle]  # at most ``shingle`` different ones
    parts = w.select("words", "items", F.explode(F.filter(shingles(F.col("words"), sizes), lambda s: s["n"] == F.col("n"))).alias("s")).select("words", "items", "s.*")
    keys = scratch.keep(parts.select("n", "h").distinct(), "keys")
    words = item_words(F.col("text"))
    seen = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.explode(shingles(F.col("w"), sizes)).alias("s"))
    seen = seen.select("doc_id", "n_words", "s.*")
    found = scratch.keep(seen.join(keys, ["n", "h"]), "occurrences")
    rarity = found.groupBy("n", "h").count()
    prefix = parts.join(rarity, ["n", "h"], "left").groupBy("words", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "h", "at", "n")).alias("p"))
    prefix = scratch.keep(prefix.filter("p.count > 0").select("words", "items", F.col("p.h").alias("h"), F.col("p.n").alias("n"), F.col("p.at").alias("offset")), "prefix")
    start = F.col("at") - F.col("offset")
    hits = found.join(prefix, ["n", "h"]).filter((start >= 0) & (start + F.size("words") <= F.col("n_words")))
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct(start.alias("start"), "words", "items")).alias("found"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``__decontam_n_words``, ``..._n_hit`` and ``..._items``."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = candidates(docs, benchmark, scratch, window, shingle)
    found = scratch.keep(found.select(F.col("doc_id").alias(P + "id"), F.col("found").alias(P + "found")), "candidates")
    # The documents' side is dealt at every size: what is found grows with them, so broadcasting it would only do for small tables.
    df = docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(found[P + "id"]), "left")
    exact = T.let(item_words(F.col("text")), lambda w: F.filter(F.col(P + "found"), lambda c: F.slice(w, c["start"] + 1, F.size(c["words"])) == c["words"]))
    # Texts without candidates are not cut into words again, unless their number is asked for.
    df = df.withColumn(P + "exact", F.when(F.col(P + "found").isNotNull(), exact))
    hits = F.col(P + "exact")
    spans = F.array_sort(F.transform(hits, lambda c: F.struct(c["start"].alias("s"), (c["start"] + F.size(c["words"])).alias("e"))))
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumns({P + "n_words": F.size(item_words(F.col("text"))).cast("long"), P + "n_hit": F.coalesce(union, F.lit(0).cast("long")), P + "items": F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda c: c["items"])))), F.array().cast("array<string>"))})
    return df.drop(P + "id", P + "found", P + "exact")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document."""
    out = mark(docs.select("doc_id", "text"), benchmark)
    items = F.col(P + "items")
    return out.select(
        "doc_id",
        F.col(P + "n_words").alias("n_words"),
        F.col(P + "n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col(P + "n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any benchmark window, with the columns of ``docs``."""
    return mark(docs, benchmark).filter(F.col(P + "n_hit") == 0).select(*docs.columns)
