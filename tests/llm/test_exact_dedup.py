"""The content sort against grouping in a dictionary."""

import collections
import hashlib
import random
import re

import pytest

from ridgeweave.llm import exact_dedup

DOCS = "doc_id long, text string, source string, sha string, body string, edge int, n long, kept boolean"


def expected(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = collections.Counter()
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[0], len(ids), k == 0, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "s", "x", "y", 1, 2, False) for i, t in rows], DOCS).repartition(parts)


def odd_rows():
    r = random.Random(4)
    rows = [(k, t) for k, t in enumerate([None, "", " ", "\n\t", "a b", "a  b", "a\n\vb", "a b ", " a b", "A b", "a b", "a\x1fb", "é\r\nß", "é ß", "long " * 60_000, "long\n" * 60_000])]
    rows += [(100 + k, "".join(r.choices("ab \n", k=r.randint(0, 6)))) for k in range(300)]
    return rows + [(3, "\n\t"), (5, "a b"), (5, "other"), (None, "a b"), (None, "only without an id"), (None, None), (-9, "a b")]


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_groups_are_those_of_a_dictionary(spark, tasks):
    rows = odd_rows()
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collections.Counter(map(tuple, exact_dedup.report(frame(spark, rows)).collect())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_group_of_a_third_of_all_rows_spreads_over_tasks(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k}") for k in range(9000)]
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = exact_dedup.by_content(frame(spark, rows)).rdd.glom().map(len).collect()
        assert max(sizes) < 3 * len(rows) / 12
        assert collections.Counter(map(tuple, exact_dedup.report(frame(spark, rows)).collect())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    assert exact_dedup.report(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert exact_dedup.keep_first(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_rows_that_stay_keep_their_columns(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = collections.Counter((x.doc_id, norm(x.text)) for x in out.collect())
    first = {}
    for i, t in rows:
        body = norm(t)
        if body not in first or (i is not None and (first[body] is None or i < first[body])):
            first[body] = i
    assert got == collections.Counter((i, body) for body, i in first.items())
