"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ridgeweave.llm import resample
from ridgeweave.llm.resample import Draw
from ridgeweave.scratch import Scratch
from tests.llm.test_operators import sentence

DOCS = "doc_id long, text string, lang string, score string, turned long, last long, n_words string, path_ordinal int"


def runs(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plainly(rows, target, how):
    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, how.longest)[0]) for texts in ([x for _, x in rows], target))
    every, wanted = sum(s.values()) + how.buckets, sum(t.values()) + how.buckets
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * every / ((s[bucket(f)] + 1) * wanted)))
    out = []
    for doc_id, text in rows:
        found, n = runs(text, how.longest)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= how.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(able[: how.percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def odd_rows():
    r = random.Random(8)
    rows = [(k, sentence(r, r.randint(15, 60)).title()) for k in range(150)]
    rows += [(k, t) for k, t in enumerate([None, "", "...", "One two", "é ß ñ " * 9, "x\x00y " * 20, "word " * 30_000], 500)]
    return rows + [(1, rows[1][1])] * 3 + [(2, sentence(r, 30)), (None, sentence(r, 25)), (None, None), (-5, sentence(r, 40)), (2**62, sentence(r, 33))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "n", 3) for i, t in rows], DOCS).repartition(4)


@pytest.mark.parametrize("how", [Draw(), Draw(longest=2, buckets=97, percent=50, least_words=3), Draw(percent=100, least_words=0), Draw(percent=0)])
def test_draws_are_those_of_plain_python(spark, how):
    r = random.Random(9)
    rows, target = odd_rows(), [sentence(r, 30) for _ in range(20)] + [None, ""]
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert sorted((tuple(x) for x in resample.draw(frame(spark, rows), wanted, how).collect()), key=repr) == plainly(rows, target, how)


def test_empty_tables(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.draw(docs.limit(0), none).count() == 0
    assert sorted((tuple(x) for x in resample.draw(docs, none).collect()), key=repr) == plainly(odd_rows(), [], Draw())


@pytest.mark.parametrize("digit", [1, 3, 16])
def test_the_kth_key_is_exact(spark, digit):
    r = random.Random(digit)
    big = 2**63
    rows = [(r.choice([-3, 0, 7, 7, 7, 70_000]), r.choice([-big, big - 1, 0, -1, r.randrange(-big, big)])) for _ in range(300)]
    df, scratch = spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "radix")
    for k in (1, 2, 149, 299, 300):
        assert resample.radix_select(df, ["a", "b"], k, scratch, digit) == sorted(rows)[k - 1]
    assert resample.radix_select(df, ["a", "b"], 301, scratch, digit) is None
    assert resample.radix_select(df, ["a", "b"], 0, scratch, digit) is None


def test_the_draw_leans_to_the_target(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(["plum", "pear", "fig"] if k % 4 else ["star", "moon", "sun"], k=30))) for k in range(400)]
    wanted = spark.createDataFrame([(k, "star moon sun " * 5) for k in range(20)], "item_id long, text string")
    chosen = [x.doc_id for x in resample.drawn(frame(spark, rows), wanted).select("doc_id").collect()]
    assert len(chosen) == 40 and sum(k % 4 == 0 for k in chosen) > 30
