"""The prefix-filtered join against all pairs."""

import itertools
import random

import pytest

from ridgeweave.operators import similar


@pytest.mark.parametrize("limits", [(0.85, 0.78, 0.88), (0.3, 0.9, 0.95), (0.9, 0.3, 0.9), (0.9, 0.9, 0.5), (0.05, 0.05, 0.05), (1.0, 1.0, 1.0)])
def test_pairs_are_those_of_all(spark, limits):
    r = random.Random(sum(limits))
    sets = {}
    for k in range(120):
        base = dict(sets[r.randrange(k)]) if k and r.random() < 0.5 else {}
        for e in r.sample(range(40), r.randint(0 if base else 1, 6)):
            base[e] = float(r.randint(1, 9))
        for e in r.sample(sorted(base), min(len(base) - 1, r.randint(0, 2))):
            del base[e]
        sets[k] = base | {99: 1.0} if k % 3 == 0 else base
    expected = set()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        both = x.keys() & y.keys()
        shared, tx, ty = sum(min(x[e], y[e]) for e in both), sum(x.values()), sum(y.values())
        if len(both) / len(x.keys() | y.keys()) >= limits[0] or shared / (tx + ty - shared) >= limits[1] or shared / min(tx, ty) >= limits[2]:
            expected.add((a, b))
    df = spark.createDataFrame([(k, e, n) for k, s in sets.items() for e, n in s.items()], "k long, e long, n double").repartition(3)
    assert {tuple(x) for x in similar.near_pairs(df, *limits).collect()} == expected


def test_limits_and_empty_tables(spark):
    df = spark.createDataFrame([], "k long, e long, n double")
    assert similar.near_pairs(df, 0.8, 0.8, 0.8).count() == 0
    with pytest.raises(ValueError):
        similar.near_pairs(df, 0.0, 0.8, 0.8)


def test_pairs_meet_once_without_a_shuffle_of_pairs(spark):
    """Counts of all pairs by a loop; nothing is dealt by pairs, so what is shuffled grows with the parts."""
    r = random.Random(3)
    sets = {k: {e: float(r.randint(1, 9)) for e in r.sample(range(25), r.randint(1, 8))} for k in range(90)}
    expected = set()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if both := x.keys() & y.keys():
            expected.add((a, b, len(both), sum(min(x[e], y[e]) for e in both), len(x) + (a == 5), len(y) + (b == 5), sum(x.values()) + (a == 5), sum(y.values()) + (b == 5)))
    rows = [(k, e, n) for k, s in sets.items() for e, n in s.items()] + [(5, None, 1.0)]
    out = similar.met_pairs(spark.createDataFrame(rows, "k long, e long, n double").repartition(3))
    assert {tuple(x) for x in out.select("a", "b", "common", "shared", "sa", "sb", "ta", "tb").collect()} == expected
    assert out.count() == len(expected)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
