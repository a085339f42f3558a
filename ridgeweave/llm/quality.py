"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates how often each rule is right when
the text is good and when it is bad, and the posterior probability of a good
text decides. There are at most 3^rules patterns, whatever the input's size,
so the counts are the only thing that reaches the driver.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; null ids stay null; repeated rows are judged alike; an empty table
gives no rows; further columns pass through ``judge`` under their own names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeweave.llm import text as T
from ridgeweave.scratch import Scratch

WINDOW = 8
P = "__quality_"


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with measures of its whole texts, each named ``__quality_...``."""
    c = lambda name: F.col(P + name)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn(P + "words", T.words(body))
    df = df.withColumn(P + "windows", T.shingle_hashes(c("words"), WINDOW))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(T.BLANK_WORDS))
    df = df.withColumns(
        {
            P + "n_words": F.size(c("words")).cast("long"),
            P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
            P + "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long"),
            P + "n_upper": (F.length(body) - F.length(F.regexp_replace(body, r"[A-Z]+", ""))).cast("long"),
            P + "n_loud": (F.length(body) - F.length(F.regexp_replace(body, r"!+", ""))).cast("long"),
            P + "lines": T.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))),
            P + "distinct_words": F.size(F.array_distinct(c("words"))).cast("long"),
            P + "n_repeat_words": F.when(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), repeated_words(c("windows"))).otherwise(F.lit(0).cast("long")),
        }
    )
    df = df.withColumns({P + "n_lines": c("lines")["n"], P + "n_dup_lines": c("lines")["n"] - c("lines")["distinct"]})
    return df.drop(P + "words", P + "windows", P + "lines")


def repeated_words(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more in the text.

    Sorting by hash brings equal windows together, so the cost is n log n in
    the text's length however often windows recur.
    """
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = T.let(tagged, lambda s: F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    return T.covered(F.array_sort(F.transform(twice, lambda x: x["i"])), WINDOW)


@dataclass(frozen=True)
class Rule:
    """Votes good if ``good`` holds, bad if ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


#: Shares are of words unless the name says otherwise; q_ stands for the features' prefix.
RULES = (
    Rule("length", "q_n_words >= 40", "q_n_words < 20"),
    Rule("word_length", "q_word_chars between 2.5 * q_n_words and 11 * q_n_words", "q_word_chars < 2 * q_n_words or q_word_chars > 16 * q_n_words"),
    Rule("symbols", "q_n_symbols <= 0.02 * q_n_words", "q_n_symbols > 0.3 * q_n_words"),
    Rule("shouting", "q_n_upper <= 0.15 * q_word_chars", "q_n_upper > 0.5 * q_word_chars"),
    Rule("exclamation", "q_n_loud <= 0.02 * q_n_words", "q_n_loud > 0.3 * q_n_words"),
    Rule("line_repeats", "q_n_dup_lines = 0 and q_n_lines >= 2", "q_n_lines >= 4 and q_n_dup_lines > 0.6 * q_n_lines"),
    Rule("window_repeats", "q_n_repeat_words <= 0.05 * q_n_words", "q_n_repeat_words > 0.3 * q_n_words"),
    Rule("vocabulary", "q_distinct_words >= 0.3 * q_n_words", "q_distinct_words < 0.1 * q_n_words"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One vote for each rule, as a string such as ``+-0+``."""
    expr = lambda s: F.coalesce(F.expr(s.replace("q_", P)), F.lit(False))
    return F.concat(*[F.when(expr(r.bad), "-").when(expr(r.good), "+").otherwise("0") for r in rules])


@dataclass(frozen=True)
class Fit:
    """What expectation-maximisation found: P(good), and P(vote | good or bad) by rule."""

    prior: float
    given_good: tuple[dict[str, float], ...]
    given_bad: tuple[dict[str, float], ...]

    def posterior(self, pattern: str) -> float:
        good, bad = math.log(self.prior), math.log1p(-self.prior)
        for vote, g, b in zip(pattern, self.given_good, self.given_bad, strict=True):
            if vote != "0":
                good, bad = good + math.log(g[vote]), bad + math.log(b[vote])
        return 1 / (1 + math.exp(min(700.0, max(-700.0, bad - good))))


def fit(counts: dict[str, int], rules: int, rounds: int = 50, floor: float = 0.001, start: float = 0.9, trust: tuple[float, float] = (20, 1)) -> Fit:
    """Expectation-maximisation over vote patterns.

    It begins with bad votes taken at their word: a bad vote is rare among
    good texts, while most rules call a bad text good, as each looks for one
    fault only. Each rate also counts ``trust`` made-up votes of that kind, a
    number that does not grow, so the data move the rates. A vote may never
    speak against its own meaning, so the two classes can't change places.
    Without votes the start decides.
    """
    good, bad = {"+": 0.998, "-": 0.002}, {"+": 0.8, "-": 0.2}
    model = Fit(start, (good,) * rules, (bad,) * rules)
    total = sum(counts.values())
    if not total:
        return model
    for _ in range(rounds):
        post = {p: model.posterior(p) for p in counts}
        prior = sum(post[p] * n for p, n in counts.items()) / total
        sides: tuple[list, list] = ([], [])
        for k in range(rules):
            rates = []
            for weight, first, made_up in ((post, good, trust[0]), ({p: 1 - x for p, x in post.items()}, bad, trust[1])):
                hit = sum(weight[p] * n for p, n in counts.items() if p[k] == "-")
                cast = sum(weight[p] * n for p, n in counts.items() if p[k] != "0")
                rates.append((hit + made_up * first["-"]) / (cast + made_up))
            if rates[0] > rates[1]:
                rates = [sum(rates) / 2] * 2
            for side, rate in zip(sides, rates, strict=True):
                rate = min(1 - floor, max(floor, rate))
                side.append({"-": rate, "+": 1 - rate})
        model = Fit(min(1 - floor, max(floor, prior)), tuple(sides[0]), tuple(sides[1]))
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``docs`` with its measures and votes, ``__quality_posterior``, ``__quality_base_failed`` and ``__quality_kept``.

    The measured rows are written once to the shared folder; the fit and the
    answer both read them from there. What the base rule rejects takes no part
    in the fit, as repetition would else be all that bad texts share.
    """
    spark = docs.sparkSession
    measured = Scratch(spark, "quality").keep(features(docs).withColumn(P + "votes", votes(rules)), "measured")
    n, repeats = F.col(P + "n_words"), F.col(P + "n_repeat_words")
    failed = (n < 20) | (100 * repeats > 30 * n)
    counts = {(r[0], r[1]): r[2] for r in measured.groupBy(P + "votes", failed.alias("failed")).count().collect()}
    model = fit({p: n for (p, gone), n in counts.items() if not gone}, len(rules))
    table = spark.createDataFrame([(p, model.posterior(p)) for p in {p for p, _ in counts}], f"{P}votes string, {P}posterior double")
    return (
        measured.join(F.broadcast(table), P + "votes", "left")
        .withColumn(P + "base_failed", failed)
        .withColumn(P + "kept", ~F.col(P + "base_failed") & (F.col(P + "posterior") >= threshold))
    )


def report(docs: DataFrame) -> DataFrame:
    """One row for each document with its measures and verdict."""
    out = judge(docs.select("doc_id", "text")).drop("text")
    return out.select("doc_id", *[F.col(P + x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "posterior")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    return judge(docs).filter(F.col(P + "kept")).select(*docs.columns)
