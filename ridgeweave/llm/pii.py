r"""Personal data: base patterns plus bootstrapped contexts, in DataFrame functions only.

Base spans come from fixed patterns and seed the second part. The words about
a span are its lexical patterns: two or one before it, one on either side, and
two behind it. A line's start, a text's end and another match stand for a word,
so a list's second entry has a pattern too. Patterns and instances, base or
identifier-like, form a graph. In each round a pattern is induced for a kind
once enough different trusted instances stand in it and they are half of all
that it holds; its confidence is the kind's share of what is known of its
instances, by their scores so far, as one that nothing is known of speaks
neither for nor against it. Where base spans overlap, the longest is the
place's seed. An instance's score is the noisy-or of the confidences of its trusted patterns,
and a trusted instance induces patterns in the next round. Instances of
trusted patterns become spans of that kind, where their shape allows it. Base
spans always stay.

Spans count code points, the end is exclusive. A match is found by splitting
the text at the pattern, so its place is the length of what lies before it.
Quantifiers are possessive where nothing could be given back, and a match may
only begin at a run's start or where the last one ended; this is what leftmost
matching finds anyway, without its square cost on long runs.

Defined results: a null or empty text has no spans; null ids stay null and
repeated rows are judged one by one; an empty table gives no rows; further
columns pass through ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.llm import text as T
from ridgeweave.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
P = "__pii_"
SPAN = "struct<s:bigint,e:bigint,value:string,contexts:array<string>>"

_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z(])\(?[0-9][0-9().\x20/-]{4,}[0-9](?![0-9A-Za-z])",
    "spelled": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z]{{2,}}+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{{2,}}+)++)",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def total(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda x, i: T.let(F.coalesce(x.try_cast("int"), F.lit(0)) * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return T.let(value, total) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return T.let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "number":
        return F.length(digits(value)).between(7, 19)
    return F.lit(True)


def _tokens(gap: Column) -> Column:
    """Lowered runs of letters and digits; a line feed gives ``^``."""
    plain = F.regexp_replace(F.lower(gap), r"[^\p{L}\p{N}\n]+", " ")
    return F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" ^ ")), " +"), "")


def contexts(before: Column, after: Column, left: Column, right: Column) -> Column:
    """Lexical patterns of a span between two gaps; ``left`` and ``right`` stand for what lies beyond them.

    A few characters nearest the span are looked at first, and the whole gap
    where they hold less than two words and the one that may be cut.
    """
    near = F.lit(64)
    last = T.let(_tokens(F.right(before, near)), lambda w: F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(T.let(F.concat(F.array(left), _tokens(before)), lambda v: F.slice(v, F.greatest(F.lit(1), F.size(v) - 1), 2))))
    first = T.let(_tokens(F.left(after, near)), lambda w: F.when(F.size(w) > 2, F.slice(w, 1, 2)).otherwise(F.slice(F.concat(_tokens(after), F.array(right)), 1, 2)))

    def made(x: Column, y: Column) -> Column:
        one = F.element_at(x, -1)
        return F.array(F.concat(F.array_join(x, " "), F.lit(" _")), F.concat(one, F.lit(" _")), F.concat(one, F.lit(" _ "), F.get(y, F.lit(0))), F.concat(F.lit("_ "), F.array_join(y, " ")))

    return F.filter(F.array_distinct(T.let(last, lambda x: T.let(first, lambda y: made(x, y)))), lambda c: c.rlike(r"[\p{L}\p{N}]"))


def spans(text: Column, kind: str) -> Column:
    """Array of SPAN for the valid matches of a kind, by start."""
    pattern = F.lit(PATTERNS[kind])
    empty = F.array().cast(f"array<{SPAN}>")

    def walk(found: Column, gaps: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            start = a["at"] + F.length(F.get(gaps, k))
            end = start + F.length(F.get(found, k))
            left, right = F.when(k == 0, "^").otherwise("#"), F.when(k == F.size(found) - 1, "$").otherwise("#")
            about = contexts(F.get(gaps, k), F.get(gaps, k + 1), left, right)
            span = F.struct(start.cast("long").alias("s"), end.cast("long").alias("e"), F.get(found, k).alias("value"), about.alias("contexts"))
            return F.struct(end.cast("long").alias("at"), F.when(valid(kind, F.get(found, k)), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])

    may = {"email": text.contains("@"), "phone": text.contains("+"), "spelled": text.rlike(r"[(\[]at[)\]]") | (text.contains(" at ") & text.contains(" dot "))}.get(kind, text.rlike("[0-9]"))
    matches = T.let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, T.let(F.split(text, PATTERNS[kind], -1), lambda g: walk(m, g))).otherwise(empty))
    return F.when(may, matches).otherwise(empty)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans by kind and with the candidates that overlap none of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumns({P + k: spans(text, k) for k in KINDS} | {P + "number": spans(text, "number"), P + "spelled": spans(text, "spelled")})

    def tagged(i: int, kind: str) -> Column:
        return F.transform(F.col(P + kind), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e"), x["value"].alias("value"), x["contexts"].alias("contexts")))

    base = F.concat(*[tagged(i, k) for i, k in enumerate(KINDS)])
    df = df.withColumns({P + "base": F.array_sort(base), P + "row": F.monotonically_increasing_id()})
    free = F.filter(F.concat(P + "number", P + "spelled"), lambda c: ~F.exists(F.col(P + "base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return df.withColumn(P + "candidates", free).drop(*[P + k for k in (*KINDS, "number", "spelled")])


@dataclass(frozen=True)
class Bootstrap:
    """``rounds`` of scoring; a pattern counts from ``support`` different trusted instances and from a share ``known`` of its instances, patterns and instances are trusted from ``confidence`` on."""

    rounds: int = 3
    support: int = 5
    confidence: float = 0.8
    known: float = 0.5


def fits(kind: Column, value: Column) -> Column:
    """Whether an identifier-like instance has the shape of a kind: letters for mail, digits alone for the others."""
    return value.rlike("[a-z]") == (kind == 0)


def discover(found: DataFrame, scratch: Scratch, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(row, extra): spans that trusted patterns find in the rows of ``located``.

    Only patterns, instances and their counts travel. Distinct pairs are
    formed before anything is counted, so a pattern that a third of the rows
    share costs one row for each task. A pattern with fewer instances than
    ``support`` can't be induced in any round and goes before the first one.
    """
    longer = lambda b, o: (o["s"] < b["e"]) & (b["s"] < o["e"]) & (F.struct(o["e"] - o["s"], -o["kind"]) > F.struct(b["e"] - b["s"], -b["kind"]))
    places = F.filter(P + "base", lambda b: ~F.exists(P + "base", lambda o: longer(b, o)))
    seeds = found.select(F.explode(places).alias("x")).select(F.col("x.kind").alias("kind"), F.lower("x.value").alias("value"), "x.contexts")
    spots = found.select(P + "row", F.explode(P + "candidates").alias("x")).select(P + "row", "x.s", "x.e", F.lower("x.value").alias("value"), F.explode("x.contexts").alias("pattern"))
    spots = scratch.keep(spots, "spots")
    known = scratch.keep(seeds.select("kind", "value").distinct().withColumn("score", F.lit(1.0)), "known")
    every = seeds.select(F.explode("contexts").alias("pattern"), "value", F.lit(True).alias("seed")).union(spots.select("pattern", "value", F.lit(False)))
    every = scratch.keep(every.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pairs")
    size = every.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= how.support)
    edges = scratch.keep(every.join(size, "pattern"), "edges")
    scores = known
    for k in range(how.rounds):
        mass = edges.join(scores, "value").groupBy("kind", "pattern").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= how.confidence).alias("trusted"), F.max("n").alias("n"))
        share = F.col("mass") / (F.sum("mass").over(W.partitionBy("pattern")) + 1)
        enough = (F.col("trusted") >= how.support) & (F.col("mass") >= how.known * F.col("n"))
        patterns = mass.withColumn("confidence", share).filter(enough & (F.col("confidence") >= how.confidence)).select("kind", "pattern", "confidence")
        patterns = scratch.keep(patterns, f"patterns{k}")
        if k + 1 < how.rounds:
            guessed = edges.filter(~F.col("seed")).join(patterns, "pattern").filter(fits(F.col("kind"), F.col("value")))
            guessed = guessed.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            scores = scratch.keep(guessed.union(known.select("kind", "value", "score")).groupBy("kind", "value").agg(F.max("score").alias("score")), f"scores{k}")
    hits = spots.join(patterns, "pattern").filter(fits(F.col("kind"), F.col("value")))
    hits = hits.groupBy(P + "row", "s", "e").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return hits.groupBy(P + "row").agg(F.array_sort(F.collect_set(F.struct("s", "kind", "e"))).alias(P + "extra"))


def detect(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with ``__pii_base`` and ``__pii_spans``, arrays of (s, kind, e) by start and kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(located(docs), "located")
    extra = scratch.keep(discover(found, scratch, how).withColumnRenamed(P + "row", P + "at"), "extra")
    return _with_extra(found, extra)


def _with_extra(found: DataFrame, extra: DataFrame) -> DataFrame:
    bare = F.transform(P + "base", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    df = found.join(extra, found[P + "row"] == extra[P + "at"], "left").withColumn(P + "base", bare)
    df = df.withColumn(P + "spans", F.array_sort(F.array_union(P + "base", F.coalesce(F.col(P + "extra"), F.array().cast("array<struct<s:bigint,kind:int,e:bigint>>")))))
    return df.drop(P + "row", P + "at", P + "extra", P + "candidates")


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document; the counts are of base spans."""
    out = detect_ids(docs)

    def count(i: int, kind: str) -> Column:
        return F.size(F.filter(P + "base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col(P + "base")), 256).alias("base_sha256"), joined(F.col(P + "spans")).alias("spans"))


def detect_ids(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """``detect`` without carrying the text along."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(located(docs.select("doc_id", "text")).drop("text"), "located")
    extra = scratch.keep(discover(found, scratch, how).withColumnRenamed(P + "row", P + "at"), "extra")
    return _with_extra(found, extra)


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), (x["s"] - a["at"]).cast("int")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(gap, F.get(names, x["kind"])))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its personal data replaced; ``n_chars`` follows where it is a column."""
    df = detect(docs).withColumn("text", redacted(F.col("text"), F.col(P + "spans")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(P + "spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
