"""Column expressions over words that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
BLANK_WORDS = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters, digits and everything beyond ASCII.
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between such words.
BLANKS, NO_LETTERS = BLANK_WORDS.replace("[^", "["), LETTER_WORDS.replace("[^", "[")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lowers A-Z and nothing else; texts of ASCII alone take the quicker built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, between: str = BLANKS) -> Column:
    """Words of a text in order, by what lies between them; none for a null.

    Splitting costs time in proportion to the text. Extracting every match
    would copy the text for each of them.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def shingle_hashes(tokens: Column, size: int) -> Column:
    """64-bit hash of each run of ``size`` words, by its first word; none if there are fewer words.

    Every word is hashed once. Two overlapping runs of hashes give that of the
    run they cover, so runs double and no list of words is cut out.
    """

    def longer(runs: Column, step: int) -> Column:
        return let(runs, lambda c: let(F.size(c) - step, lambda n: F.zip_with(F.slice(c, 1, n), F.slice(c, 1 + step, n), lambda x, y: F.xxhash64(x, y))))

    runs, have = F.transform(tokens, lambda w: F.xxhash64(w)), 1
    while have < size:
        step = min(have, size - have)
        runs, have = longer(runs, step), have + step
    return F.when(F.size(tokens) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def covered(starts: Column, width: int) -> Column:
    """How many places the intervals [start, start + width) cover; ``starts`` ascends."""
    return let(
        starts,
        lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.least(F.lit(width).cast("long"), F.coalesce(F.get(s, k + 1), p + width).cast("long") - p)),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ),
    )
