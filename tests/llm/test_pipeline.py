"""The pipeline against its stages' brute-force versions, on a small table."""

import collections
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import linked, sentence  # noqa: E402

from ridgeweave.llm.registry import tokenizer_path  # noqa: E402


def test_every_stage_takes_effect(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(12)
    clean = {k: sentence(r, 90) for k in range(30)}
    junk = {100 + k: " ".join(w + "$$$" for w in sentence(r, 60).split()) for k in range(4)}
    copies = {200: clean[3], 201: clean[4] + " and one more"}
    leaked = {300: clean[5][:100] + " " + sentence(r, 20)}
    item = sentence(r, 15)
    leaked[301] = sentence(r, 40) + " " + item + " " + sentence(r, 40)
    private = {400: sentence(r, 60) + " mail me at a.b@c.org"}
    rows = {**clean, **junk, **copies, **leaked, **private}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(k, t) for k, t in rows.items() if k not in junk and len(t.split()) >= 20]
    left = [(k, dict(left)[k]) for k, _, _, keep in linked(left, 5) if keep]
    left = [(k, t.replace("a.b@c.org", "[EMAIL]")) for k, t in left if item not in t]
    tok = Tokenizer.from_file(tokenizer_path())
    expected = collections.Counter({k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in left})
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == dict(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "best-fit packing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_pass_every_stage(spark, tmp_path, name):
    """Nulls in any column, empty, repeated and long texts, clashing columns, empty tables."""
    r = random.Random(3)
    item = sentence(r, 15)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = sentence(r, 60)
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, sentence(r, 60), "en", None, 1), (4, sentence(r, 40_000), "en", "s", 2), (5, "word " * 3000, "en", "s", 3)]
    docs = spark.createDataFrame([(*x, k, "z", 1.0) for k, x in enumerate(rows)], COLUMNS + ", n long, h string, kept double")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    ids = {x.doc_id for x in out.select("doc_id").collect()}
    assert 4 in ids and 1 in ids and None in ids
    if name != "best-fit packing":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
