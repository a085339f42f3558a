"""The operators against brute force on small tables, with nulls, blanks, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import json
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeweave.llm import decontam, html_text, licenses, maxent, near_dup, packing, pii, quality, suffix_dedup, warc
from ridgeweave.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, id string, words string, size int, sig string, kind int"
PAGES = "page_id long, url string, html string, payload string, digest string, salt int, first long"
SYLLABLES = "the an on er in re tion ing ou ea st ha th of to be wh".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    base = [sentence(r, 120) for _ in range(12)]
    near = [re.sub(r"^\S+ \S+", "other words", base[0]), base[0] + " and more", " ".join(base[1].split()[:-3])]
    out = [None, "", " \n\t ", "One", "One", "two words", base[0], *base, *near, "A" * 5000, "é ß ñ " * 40, "1" * 4000, "\n".join([base[2][:80]] * 30), base[3] + "\n" + base[4], base[5].upper() + "!!", "x" * 49, base[6][:50] + base[7]]
    rows = [(k, t) for k, t in enumerate(out)]
    return rows + [rows[8], (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en", "src0", len(t or ""), 1, "x", "y", 2, "z", 3) for i, t in texts()]
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    t = dict(x for x in texts() if x[0] is not None)
    items = [(1, " ".join(t[8].split()[20:45])), (2, " ".join(t[9].split()[:10]).upper()), (3, "two words"), (4, None), (5, ""), (6, " ".join(t[8].split()[20:45])), (None, "One"), (7, sentence(random.Random(99), 30))]
    return spark.createDataFrame(items, "item_id long, text string")


def low(text):
    return (text or "").encode().lower().decode()


def got(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def test_empty_tables(spark, no_docs, benchmark):
    none = [packing.pack_documents(no_docs, tokenizer_path()), suffix_dedup.report(no_docs), pii.report(no_docs), maxent.score(no_docs), near_dup.link(no_docs), decontam.report(no_docs, benchmark), quality.report(no_docs), licenses.report(no_docs)]
    none += [f(no_docs) for f in (quality.keep_good, near_dup.keep_first, pii.redact)]
    pages = spark.createDataFrame([], PAGES)
    none += [warc.round_trip(pages), html_text.extract(pages)]
    assert [df.count() for df in none] == [0] * len(none)


def test_empty_benchmark(docs, benchmark):
    assert decontam.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_stages_keep_the_columns(docs, benchmark):
    for df in (quality.keep_good(docs), near_dup.keep_first(docs), decontam.clean(docs, benchmark), pii.redact(docs)):
        assert df.columns == docs.columns


# -- packing ----------------------------------------------------------------------


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = packing.pack_documents(docs, tokenizer_path(), size=256, bins=8)
    expected = collections.Counter()
    for i, t in texts():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 256):
            expected[(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    by_sequence = collections.defaultdict(list)
    for r in out.collect():
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


COMBINING = "\u0300\u0301\u0307\u030c\u0327\u0331\u0338\u0345\u05b4\u0f71"
ODD = "aBJHiIjZ\u0130\u0131'. \u00e9\u00c9\u00df\u1e9e\u01c5\u03a3,!=<|endoftext|>\x1c \n1\uff19\u6f22\u00aa\u0250" + COMBINING


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.text(alphabet=ODD, max_size=30), st.text(max_size=20)), max_size=4))
def test_chunks_have_the_tokenizers_ids(some):
    encoder = packing.encoder(tokenizer_path(), 1)
    whole = [b"".join(i.to_bytes(4, "little") for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]) for t in some]
    assert list(encoder.encode(some)) == whole


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 6))
def test_bins_are_never_too_full(lengths, bins):
    fit, used = packing.BestFit(64, bins, 0), collections.Counter()
    for n in lengths:
        at, offset = fit.place(n)
        assert offset == used[at]
        used[at] += n
        assert fit.open <= bins and used[at] <= 64


# -- suffix arrays -------------------------------------------------------------------


def removed(rows):
    """Brute force: bytes covered by a 50-byte string that starts in a document with a smaller id."""
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[(i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())] = None
    return out


def test_suffix_dedup(docs):
    out = suffix_dedup.report(docs)
    assert out.count() == len(texts())
    assert set(got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == set(removed(texts()))


def test_suffix_entries_are_small_and_so_is_what_a_task_holds():
    """24 bytes for an anchor where documents fit in four; far ids keep eight. Tables and columns stay below 120 MB."""
    import tracemalloc

    r = np.random.default_rng(1)
    texts = [bytes(x).decode("latin-1") for x in r.integers(32, 127, (16, 1 << 18), np.uint8)]
    for shift, width in ((0, 24), (1 << 40, 28)):
        docs = pa.RecordBatch.from_pydict({"doc_id": [k + shift for k in range(16)], "text": texts, "h": [0] * 16})
        tracemalloc.start()
        rows = [x for batch in suffix_dedup.index_task(4)([docs]) for x in zip(*(c.to_pylist() for c in batch.columns[4:8]), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        n = sum(len(x[1]) for x in rows) // 8
        assert n > 1 << 17 and sum(map(len, sum(rows, ()))) == width * n
        assert peak < 120e6
        assert {int(d) for x in rows for d in np.frombuffer(suffix_dedup.widened(x[3], len(x[1]) // 8), np.int64)} == set(docs.to_pydict()["doc_id"])


def test_suffix_dedup_over_many_tasks_and_cuts(spark, monkeypatch):
    r = random.Random(8)
    parts = [sentence(r, 12) for _ in range(30)]
    rows = [(k, "".join(r.choice(parts) + r.choice(["", " x ", "-"]) for _ in range(r.randint(1, 14)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = suffix_dedup.report(df)
    assert set(got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == set(removed(rows))
    # long texts are looked at in parts; their anchors don't depend on where the parts begin
    data = "".join(parts).encode() * 3
    whole = list(suffix_dedup.all_anchors([data]))
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    pieces = list(suffix_dedup.all_anchors([data]))
    places = lambda found: {(p, k, c) for x in found for p, k, c in zip(x[1].tolist(), x[2].tolist(), x[3].tolist(), strict=True)}
    assert places(whole) <= places(pieces)


@pytest.mark.parametrize("same", ["low bits of the context", "context", "check"])
def test_contexts_that_agree_in_part_differ(monkeypatch, same):
    r, plain = random.Random(3), suffix_dedup.all_anchors
    common = sentence(r, 30)[:49]
    rows = [(k, sentence(r, 20)[:60] + common + sentence(r, 20)[:60], k) for k in range(6)]
    data = pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows]) for c in range(3)], names=["doc_id", "text", "h"])
    alike = {"low bits of the context": lambda c, d: (c << np.uint64(32), d), "context": lambda c, d: (c * np.uint64(0), d), "check": lambda c, d: (c, d * np.uint64(0))}[same]
    monkeypatch.setattr(suffix_dedup, "all_anchors", lambda some: ((t, p, k, *alike(c, d), a, b) for t, p, k, c, d, a, b in plain(some)))
    entries = list(suffix_dedup.index_task(1)([data]))
    flags = list(suffix_dedup.scan_task()(entries))
    assert {k for x in entries for k in x.column(1).to_pylist()} == {suffix_dedup.ENTRIES}
    assert {k for x in flags for k in x.column(1).to_pylist()} == {suffix_dedup.CLOSER}


def test_the_second_prints_are_sums_modulo_a_prime():
    """And where two letters change places, neither print follows from the other."""
    data = np.frombuffer(b"abcabdxyzabcabdxyz" * 12, np.uint8)
    check, first = suffix_dedup.Checks(data), suffix_dedup.Prints(data)
    power = [pow(suffix_dedup.THIRD, k, suffix_dedup.PRIME) for k in range(250)]
    value = [int(v) % (suffix_dedup.PRIME + 1) for v in suffix_dedup.byte_values(7)[data]]
    at = np.arange(0, 100, 7)
    odd = suffix_dedup.remainder(suffix_dedup.remainder(check.sums[at + 50] - check.sums[at]) * check.inverse[at])
    assert odd.tolist() == [sum(value[i + k] * power[k] for k in range(50)) % suffix_dedup.PRIME for i in at.tolist()]
    assert (check.of(at, at + 50) == check.of(at + 18, at + 68)).all() and (first.of(at, at + 50) == first.of(at + 18, at + 68)).all()
    swapped = [np.frombuffer(bytes(x), np.uint8) for x in (b"ab" + b"q" * 60, b"ba" + b"q" * 60)]
    ends = (np.array([0]), np.array([62]))
    apart = lambda make: int(make(swapped[0]).sums[62]) - int(make(swapped[1]).sums[62])
    second = lambda d: suffix_dedup.Prints(d, 6, suffix_dedup.SECOND)
    values = [int(suffix_dedup.byte_values(s)[97]) - int(suffix_dedup.byte_values(s)[98]) for s in (5, 6)]
    assert (apart(suffix_dedup.Prints) * values[1] - apart(second) * values[0]) % (1 << 64) != 0
    assert suffix_dedup.Checks(swapped[0]).of(*ends) != suffix_dedup.Checks(swapped[1]).of(*ends)


def test_differing_texts_of_one_document(spark):
    r = random.Random(13)
    x, z = sentence(r, 30), sentence(r, 40)
    rows = [(1, x), (2, x + " and a tail of its own that is long enough"), (2, z), (2, z), (3, z[:90])]
    out = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert set(got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == set(removed(rows)) and out.count() == 5


def test_levels_grow_geometrically_and_are_scanned_as_they_merge():
    gone = []

    def scan(level):
        new = suffix_dedup.group_starts(*level[:2])
        gone.extend(level[2][~new].tolist())
        return [x[new] for x in level]

    family = suffix_dedup.Family(1, scan)
    for k in range(9):
        key = np.arange(k, k + 4, dtype=np.uint64)
        family.add([key, key, np.full(4, k)])
        sizes = [len(level[0]) for level in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    assert family.merged()[1].tolist() == list(range(12)) and len(gone) == 24


def test_entries_that_share_a_place_in_the_order_are_told_apart():
    found = []

    def scan(level):
        found.append(np.count_nonzero(suffix_dedup.group_starts(*level[1:3])))
        return level

    family = suffix_dedup.Family(2, scan)
    place = np.zeros(6, np.uint64)
    family.add([place, np.array([1, 2, 1, 2, 1, 2]), np.array([5, 6, 5, 6, 7, 6]), np.arange(6)])
    assert found == [3]


def test_long_texts_are_deduplicated_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 5000)
    r = random.Random(14)
    long = sentence(r, 9000)
    rows = [(1, long[40_000:40_600]), (2, long), (3, "new " + long[100:20_000] + " end")]
    out = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert set(got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == set(removed(rows))


# -- archives ------------------------------------------------------------------------


def pages_of(spark):
    big = "<p>" + "body " * 40 + "</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, "http://a 9", big + "é"), (3, None, "small"), (4, "u", "small"), (7, "u", None), (8, "u", ""), (2, "again", big), (None, "u", big), (None, "u", "tiny")]
    return rows, spark.createDataFrame([(*x, "p", "d", 1, 1) for x in rows], PAGES).repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages_of(spark)
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    expected = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and firsts[h] != i and sum(x[2] == h for x in rows) > 1
        expected[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", firsts[h] if again else None)] += 1
    assert got(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected


def test_long_urls_and_damaged_archives(spark, caplog, monkeypatch):
    pages = spark.createDataFrame([(k, "http://x/" + "u" * (200_000 if k == 2 else 3), f"<p>{k}</p>" * 60) for k in range(6)], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in warc.round_trip(pages).collect()} == set(range(6))
    table = warc.archives(pages)
    name, data = table.first()
    hurt = spark.createDataFrame([(name, bytes(data[:200]) + b"\x00" * 40 + bytes(data[240:]))], "archive string, data binary")
    found = warc.read(hurt).cache()
    with caplog.at_level("WARNING"):
        assert warc.logged_gaps(found) >= 1
    assert "quarantined" in caplog.text and len({r.page_id for r in found.filter("gap is null").collect()}) >= 4
    monkeypatch.setattr(warc, "archives", lambda _: hurt)
    with pytest.raises(RuntimeError, match="read back"):
        warc.round_trip(pages)


def test_salvage_recovers_what_follows_damage():
    records = [warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 30, None) for k in range(6)]
    good = [warc.member(r) for r in records]
    bad = bytearray(good[2])
    bad[len(bad) // 2] ^= 0xFF
    cut = good[4][: len(good[4]) // 2]
    data = good[0] + b"\x00noise" + records[1] + bytes(bad) + good[3] + cut + good[5]
    out = list(warc.salvage(data))
    ids = [x[2].headers["warc-record-id"] for x in out if not isinstance(x[2], str)]
    assert ids == [f"<urn:page:{k}>" for k in (0, 1, 3, 5)]
    gaps = [(a, b) for a, b, x in out if isinstance(x, str)]
    assert sum(b - a for a, b in gaps) == len(b"\x00noise") + len(bad) + len(cut)
    assert [x[0] for x in out] == [0] + [x[1] for x in out[:-1]] and out[-1][1] == len(data)
    altered = records[0].replace(b"payload 0", b"payload X", 1)
    assert [type(x[2]) for x in warc.salvage(altered + records[1])] == [str, warc.Record]


def test_long_headers_and_members_of_many_records():
    long = warc.record(1, "http://x/" + "q" * 70_000, b"payload", None)
    assert [type(x[2]) for x in warc.salvage(warc.member(long))] == [warc.Record]
    records = [warc.record(k, f"http://x/{k}", random.Random(k).randbytes(400), None) for k in range(5)]
    ids = lambda data: [x[2] if isinstance(x[2], str) else x[2].headers["warc-record-id"] for x in warc.salvage(data)]
    bad = records[2][:-20] + b"x" * 16 + warc.END
    assert ids(warc.member(b"".join([*records[:2], bad, *records[3:]]))) == ["<urn:page:0>", "<urn:page:1>", "warc-block-digest differs", "<urn:page:3>", "<urn:page:4>"]
    whole = warc.member(b"".join(records))
    assert ids(whole[: len(whole) // 2])[0] == "<urn:page:0>"


# -- personal data ---------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and sum(sum(divmod(int(c) * (k % 2 + 1), 10)) for k, c in enumerate(reversed(re.sub("[^0-9]", "", v)))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def base_spans(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


PRIVATE = [
    "a.b+c@d-e.f.gh x@y", "a@b.cxx+y@d.e.f", "@@a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.001", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (743) 555-3824, +12 and +1234567890123456", "é+44 20 7946 0958ß", "1-2-3--4 5  6", "4465758382889437 4465758382889437", "12345678901234567890", "", None,
]


def test_base_spans(spark, docs):
    rows = [(100 + k, t) for k, t in enumerate(PRIVATE)] + texts()
    out = pii.report(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = collections.Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows)
    assert got(out, "doc_id", "base_sha256") == expected


@settings(deadline=None, max_examples=5)
@given(st.lists(st.text(alphabet="019.+-@a (é%", max_size=60), min_size=20, max_size=60))
def test_base_spans_of_random_texts(spark, some):
    rows = list(enumerate(some))
    out = pii.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert got(out, "doc_id", "base_sha256") == collections.Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows)


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(k, f"Hello, please call me: +1 (743) 555-{1000 + k} today") for k in range(12)]
    rows = [*seeds, (50, "so please call me: 743 555 9911 then"), (51, "a build number 743 555 9911 here")]
    got_ = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got_[50] == "phone:19:31"
    assert got_[0].startswith("phone:23:")


LIKE = {
    "number": (r"(?<![0-9A-Za-z(])\(?[0-9][0-9(). /-]{4,}[0-9](?![0-9A-Za-z])", lambda v: 7 <= len(re.sub("[^0-9]", "", v)) <= 19),
    "spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z]{2,}+", lambda v: True),
}


def places(text, pattern, ok):
    """(start, end, value, patterns) of every valid match, its patterns found from all words about it."""
    found, out = list(re.finditer(pattern, text)), []
    words = lambda gap: regex.sub(r"[^\p{L}\p{N}\n]+", " ", gap.lower()).replace("\n", " ^ ").split()
    for k, m in enumerate(found):
        first, last = k == 0, k + 1 == len(found)
        x = (["^" if first else "#"] + words(text[0 if first else found[k - 1].end() : m.start()]))[-2:]
        y = (words(text[m.end() : len(text) if last else found[k + 1].start()]) + ["$" if last else "#"])[:2]
        made = {" ".join(x) + " _", x[-1] + " _", f"{x[-1]} _ {y[0]}", "_ " + " ".join(y)}
        if ok(m[0]):
            out.append((m.start(), m.end(), m[0].lower(), {c for c in made if regex.search(r"[\p{L}\p{N}]", c)}))
    return out


def bootstrapped(rows, how):
    """All spans of every row, by plain loops over the whole graph."""
    seeds, spots, base, about = set(), [], {}, collections.defaultdict(set)
    for i, t in rows:
        base[i] = {(s, k, e) for k, kind in enumerate(BASE) for s, e, *_ in places(t, *BASE[kind])}
        free = [p for kind in LIKE for p in places(t, *LIKE[kind]) if not any(s < p[1] and p[0] < e for s, _, e in base[i])]
        every = [(k, p) for k, kind in enumerate(BASE) for p in places(t, *BASE[kind])]
        fixed = [(k, p) for k, p in every if not any(o[0] < p[1] and p[0] < o[1] and (o[1] - o[0], -j) > (p[1] - p[0], -k) for j, o in every)]
        seeds |= {(k, p[2]) for k, p in fixed}
        spots += [(i, p) for p in free]
        for _, _, value, patterns in [p for _, p in fixed] + free:
            for c in patterns:
                about[c].add(value)
    seeded, score, trusted = {v for _, v in seeds}, dict.fromkeys(seeds, 1.0), {}
    fits = lambda k, v: (k == 0) == bool(re.search("[a-z]", v))
    for _ in range(how.rounds):
        trusted = {}
        for c, values in about.items():
            total = sum(score.get((k, v), 0.0) for k in range(4) for v in values)
            for k in range(4):
                have = [score.get((k, v), 0.0) for v in values]
                if sum(x >= how.confidence for x in have) >= how.support and sum(have) >= how.known * len(values) and sum(have) / (total + 1) >= how.confidence:
                    trusted[k, c] = sum(have) / (total + 1)
        miss = collections.defaultdict(lambda: 1.0)
        for (k, c), x in trusted.items():
            for v in about[c] - seeded:
                if fits(k, v):
                    miss[k, v] *= 1 - x
        score = dict.fromkeys(seeds, 1.0) | {at: 1 - x for at, x in miss.items()}
    for i, (s, e, v, patterns) in spots:
        kinds = [(x, -k) for (k, c), x in trusted.items() if c in patterns and fits(k, v)]
        if kinds:
            base[i].add((s, -max(kinds)[1], e))
    return {i: ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(x)) for i, x in base.items()}


def letters(r, n):
    return "".join(r.choices("abcdefghijklmnop", k=n))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_discovered_spans_are_those_of_plain_loops(spark, rounds):
    r = random.Random(9)
    number = lambda: f"{r.randint(200, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
    cues, tails, rows = ["call me", "phone:", "dial\nnow", "Fax -", "ring " + "y" * 90, "İ Σ", "the"], ["today", "or", "\nbye", "z" * 90, ""], []
    for k in range(400):
        parts = []
        for _ in range(r.randint(0, 4)):
            value = r.choice([lambda: "+1 " + number(), number, number, lambda: f"{letters(r, 4)}@{letters(r, 3)}.net", lambda: f"{letters(r, 5)} (at) {letters(r, 4)} (dot) org", lambda: "10.0.0." + str(r.randint(0, 300)), lambda: "4111 1111 1111 1111"])()
            parts.append(r.choice([letters(r, 3) + " ", "", "mail "]) + r.choice(cues) + " " + value + " " + r.choice(tails))
        rows.append((k, r.choice([" ", "\n", ". "]).join(parts)))
    rows += [(900 + k, f"call me +1 {number()} today") for k in range(30)] + [(950 + k, f"call me {number()} or reach line {k % 7} at {number()} or") for k in range(30)]
    rows += [(1000 + k, f"write to: {letters(r, 6)}@{letters(r, 4)}.com please") for k in range(9)] + [(1020 + k, f"write to: {letters(r, 6)} [at] {letters(r, 4)}.com please") for k in range(2)]
    how = pii.Bootstrap(rounds=rounds, confidence=0.6)
    out = pii.detect_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), how)
    got_ = {x.doc_id: x.spans for x in out.select("doc_id", pii.joined(F.col("__pii_spans")).alias("spans")).collect()}
    expected = bootstrapped(rows, how)
    assert got_ == expected
    assert sum(len(x.split(",")) for x in expected.values()) > sum(len(base_spans(t).split(",")) for _, t in rows)


def test_trusted_instances_induce_patterns(spark):
    """No base span stands behind "reach at": only numbers that "call me" finds lead there."""
    n = lambda k: f"743 555 {1000 + k}"
    rows = [(k, f"{'w' * (k + 1)} call me +1 {n(k)} soon") for k in range(100)] + [(100 + k, f"{'w' * (k + 1)} call me {n(500 + k)} soon, reach {'v' * (k + 1)} at: {n(500 + k)} {'u' * (k + 1)}") for k in range(12)]
    rows += [(200, "xx at: 743 555 7777 yy"), (201, "xx in 743 555 7777 yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda rounds: {x.doc_id: [tuple(s) for s in x["__pii_spans"]] for x in pii.detect_ids(df, pii.Bootstrap(rounds=rounds)).collect()}
    once, more = find(1), find(3)
    assert once[200] == [] and more[200] == [(7, 3, 19)]
    assert once[201] == more[201] == []


@pytest.mark.parametrize("unseen", [7, 14, 25])
def test_unseen_numbers_in_trusted_words_are_found(spark, unseen):
    """From a tenth to nearly a third of all numbers in the words have no sign of their own."""
    r = random.Random(unseen)
    digits = lambda: f"7{r.randint(100, 999)} {r.randint(1000, 9999)}"
    call = "Please call me on phone number {} any time today"
    rows = [(k, call.format(f"+44 20 {digits()}")) for k in range(60)] + [(100 + k, call.format(f"020 {digits()}")) for k in range(unseen)]
    rows += [(300 + k, f"write to me at {letters(r, 5)}@{letters(r, 4)}.org please") for k in range(20)] + [(400, "write to me at jdoe at example dot com please")]
    clean = [(500 + k, f"The order of {r.randint(1000, 9999)} {r.randint(1000, 9999)} pieces came in {letters(r, 5)} at noon dot and was number {r.randint(10**7, 10**8)} in all") for k in range(250)]
    out = {x.doc_id: x.spans for x in pii.report(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all(out[100 + k] == f"phone:{(at := call.index('{'))}:{at + 13}" for k in range(unseen))
    assert out[400] == "email:15:38"
    assert all(out[i] == "" for i, _ in clean)


def test_contexts_of_very_long_gaps(spark):
    rows = [(k, f"{'x ' * 30_000}{'q' * 30_000} +1 743 555 {1000 + k} {'z' * 30_000}") for k in range(12)] + [(9, f"{'q' * 30_000} 743 555 9999 end"), (10, "(" * 100_000 + "1 1" + "(" * 100_000)]
    got_ = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got_[9] == "phone:30001:30013" and got_[10] == ""


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or 10.0.0.1 now", 99), (2, "nothing", 7), (3, None, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out == {1: ("mail [EMAIL] or [IP] now", 24), 2: ("nothing", 7), 3: (None, None)}


# -- language model ------------------------------------------------------------------------


def test_scores(docs):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts()]
    count = collections.Counter(w for i, ws in tokens if not maxent.held_out(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    out = maxent.score(docs, maxent.Shape(batch=64)).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == collections.Counter((i, maxent.held_out(i), len(w), sum(count[x] > 0 for x in w), total) for i, w in tokens)
    expected = sorted(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w) for _, w in tokens)
    assert sorted(r.base_score for r in out) == pytest.approx(expected)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_the_model_beats_unigrams_on_held_out_texts(spark):
    r = random.Random(4)
    tongues = [["".join(r.choices("abcdefgh", k=4)) + e for _ in range(60)] for e in ("ing", "eau", "ung", "cion")]
    rows = [(k, " ".join(r.choices(tongues[k % 4], k=80))) for k in range(400)]
    out = maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), maxent.Shape()).filter("held_out").toPandas()
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 0.2


def test_context_tells_words_of_one_class_apart(spark):
    """All words end alike, so only the cells' features can tell which one follows."""
    r = random.Random(5)
    words = [f"{a}{b}ing" for a in "abcdefgh" for b in "klmnop"]
    follows = {w: r.choice(words) for w in words}
    rows = []
    for k in range(500):
        w = [r.choice(words)]
        while len(w) < 60:
            w.append(follows[w[-1]] if r.random() < 0.9 else r.choice(words))
        rows.append((k, " ".join(w)))
    out = maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), maxent.Shape(cells=32, batch=128)).filter("held_out").toPandas()
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 0.5


def test_every_training_word_reaches_the_weights(spark):
    s = maxent.Shape()
    ids = [k for k in range(40) if not maxent.held_out(k)]
    table = maxent.blocks(spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in ids], "doc_id long, text string").coalesce(1), s).cache()
    bias = np.zeros(s.classes, np.float32), np.zeros((s.classes, s.cells), np.float32)
    weights = maxent.train_round(table, s.empty(), bias, s, 0)
    sizes, words, vocab, classes = maxent.opened(table.first())
    for w, rows in zip(weights, maxent.features(vocab, classes, words, np.cumsum(sizes) - sizes, s), strict=True):
        assert all(w[r].any(axis=1).all() for r in rows)


def test_probabilities_sum_to_one():
    s = maxent.Shape(classes=8, cells=4, bits=4, cell_bits=5)
    r = np.random.default_rng(1)
    w = r.normal(size=(s.rows(), 8)).astype(np.float32)
    p = maxent.softmax(w, tuple(np.arange(5) for _ in range(4)), np.zeros(8, np.float32))
    q = maxent.softmax(r.normal(size=(32, 4)).astype(np.float32), tuple(np.arange(8) for _ in range(3)), np.zeros((8, 4), np.float32))
    assert p.sum(axis=1) == pytest.approx(np.ones(5), abs=1e-5) and (p @ q).sum(axis=1) == pytest.approx(np.ones(5), abs=1e-5)


def test_changes_of_many_tasks_are_averaged_by_examples(spark):
    s = maxent.Shape(block_bytes=1 << 10)
    rows = [(k, " ".join(sentence(random.Random(k), 50).split())) for k in range(60)]
    table = maxent.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), s).cache()
    bias = np.zeros(s.classes, np.float32), np.zeros((s.classes, s.cells), np.float32)
    several = maxent.train_round(table, s.empty(), bias, s, 0)
    assert all(np.isfinite(w).all() and w.any() for w in several)


# -- near-duplicates ---------------------------------------------------------------------------


def linked(rows, words, percent=80):
    """Brute force: set sizes and smallest reachable ids."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    ids = [i for i, _ in rows]
    label = {i: i for i in ids if i is not None}
    for _ in ids:
        for a, i in enumerate(ids):
            for b, j in enumerate(ids[:a]):
                both = len(sets[a] & sets[b])
                if None not in (i, j) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[i] = label[j] = min(label[i], label[j])
    return collections.Counter((i, len(s), label.get(i), i is None or label[i] == i) for i, s in zip(ids, sets, strict=True))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    assert got(near_dup.link(docs, near_dup.Forest(words=words)), "doc_id", "n_shingles", "component_id", "kept") == linked(texts(), words)


def varied(r: random.Random, base: list[str], changes: int) -> str:
    w = list(base)
    for at in r.sample(range(len(w)), changes):
        w[at] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("changes", [(0, 6), (3, 9), (14, 14)])
def test_large_regions_lose_no_link(spark, changes):
    """Groups whose pairs lie above, around and below the least similarity."""
    r = random.Random(2)
    base = sentence(r, 100).split()
    rows = [(k, varied(r, base, r.randint(*changes))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dup.link(df, near_dup.Forest(words=2)), "doc_id", "n_shingles", "component_id", "kept") == linked(rows, 2)


def test_the_exact_join_finds_what_neighbours_miss(spark):
    """With one tree and one neighbour the order alone finds little; the join makes up for it."""
    r = random.Random(4)
    base = sentence(r, 80).split()
    rows = [(k, varied(r, base, r.randint(0, 5))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = near_dup.Forest(words=2, trees=1, least=1, near=1)
    whole = {i for i, *_ in near_dup.link(df, few).filter("component_id = 0").collect()}
    known = {i for i, _, c, _ in linked(rows, 2) if c == 0}
    assert whole <= known and len(whole) > 0.5 * len(known)


def test_texts_of_one_document_link_it(spark):
    r = random.Random(6)
    a, b = sentence(r, 60), sentence(r, 60)
    rows = [(5, a), (5, b), (9, a + " tail"), (3, b + " tail"), (7, sentence(r, 60)), (5, a)]
    out = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.Forest(words=2)).collect()
    assert {(x.doc_id, x.component_id) for x in out} == {(5, 3), (9, 3), (3, 3), (7, 7)} and len(out) == len(rows)


def test_parity_sketches_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 400, 200, np.uint64)) for _ in range(2))
        bits = sum(int(v).bit_count() for v in (near_dup.parity_sketch(x) ^ near_dup.parity_sketch(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))


def test_one_row_of_each_component_stays(docs):
    kept = near_dup.keep_first(docs)
    expected = {i for i, _, c, k in linked(texts(), 5) if k}
    assert {r.doc_id for r in kept.collect()} == expected


# -- decontamination -----------------------------------------------------------------------------


def test_decontamination(docs, benchmark):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    items = [(r.item_id, find(r.text)) for r in benchmark.collect()]
    expected = collections.Counter()
    for i, t in texts():
        w, hit, which = find(t), set(), set()
        for item, x in items:
            for run in [x] if 0 < len(x) < 10 else [x[k : k + 10] for k in range(len(x) - 9)]:
                for k in range(len(w) - len(run) + 1):
                    if w[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        which |= {str(item)} if item is not None else set()
        expected[(i, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit))] += 1
    assert got(decontam.report(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


# -- pages -------------------------------------------------------------------------------------------


def page(body, extra=""):
    return f'<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this now and save a lot of money today.</div>{body}<footer>&copy; site</footer>{extra}'


ARTICLE = "<h1>A &eacute; title</h1><p><b>Lead text of the article stands here.<br><p>First  paragraph\n of the article with enough words to count.</p><p>Short.</p><p>Second paragraph of the article with enough words to count.</p>"
EXPECTED = "A é title\nLead text of the article stands here.\nFirst paragraph of the article with enough words to count.\nShort.\nSecond paragraph of the article with enough words to count."


@pytest.mark.parametrize(
    "html,text",
    [
        (page(f"<article>{ARTICLE}</article>"), EXPECTED),
        (page(f'<div id="content">{ARTICLE}</div><div class="comments"><p>Nice article I liked it very much, thank you for it.</p></div>'), EXPECTED),
        (page(f'<main><aside>Related words that stand at the side of the page.</aside>{ARTICLE}<form><label>Mail</label></form></main>', "</body></html>"), EXPECTED),
        (None, ""), ("", ""), ("<p>", ""), ("<nav>Home</nav>", ""), ("just text", "just text"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PARAGRAPHS = [f"{k} " + "Some longer words make up each paragraph of this article here. " * 6 for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize(
    "before,after",
    [
        ('<div class="content no-sidebar">', "</div>"),
        ('<div class="content-area has-sidebar">', "</div>"),
        ('<div class="layout-sidebar-right">', '<div class="sidebar"><p>Other things to read.</p></div></div>'),
        ('<section class="promotion-rules">', "</section>"),
        ("<form><div>", "</div><input><button>Send</button></form>"),
        ('<div class="ad"><div>', "</div>"),
        ("<div><ul></ul>", "</div>"),
        ("<nav><a>Home</a></nav>", '<div class="comments"><p>Thank you for this nice article, I read it twice.</p></div>'),
    ],
)
def test_names_alone_hide_no_article(before, after):
    assert html_text.main_text(f"<html><body>{before}{BODY}{after}</body></html>") == "\n".join(p.strip() for p in PARAGRAPHS)


TEXT = "\n".join(p.strip() for p in PARAGRAPHS)


def replies(n, tag="div", name="comment"):
    return "".join(f'<{tag} class="{name}"><b>Ann {k}</b><p>I liked this article very much, reply {k}, thank you for it, really it was so nice.</p></{tag}>' for k in range(n))


@pytest.mark.parametrize("n", [3, 12, 120])
@pytest.mark.parametrize("layout", ['<article>{0}<div class="post-comments">{1}</div></article>', '<article>{0}</article><div class="entry-comments">{1}</div>', '<article>{0}</article><section id="comments">{1}</section>', '<main>{0}<div class="discussion">{1}</div></main>', "<main>{0}<div class=x7>{1}</div></main>", '<div class="post has-comments">{0}</div><ol class="comment-list">{1}</ol>'])
def test_readers_comments_go_however_many(layout, n):
    """From a few to more than nine tenths of the page's text."""
    assert html_text.main_text(f"<html><body>{layout.format(BODY, replies(n))}</body></html>") == TEXT


@pytest.mark.parametrize(
    "html,text",
    [
        (f'<article><p>One line article.</p></article><div class="cookie-notice">{"We use cookies to make this site better for you. " * 9}</div>', "One line article."),
        (f'<article><h1>T</h1><h2 class="related-work">Related work</h2>{BODY}<p class="notice-period">The notice period is one month.</p><p class="search-results">Results are shown.</p><p class="share">Share</p></article>', f"T\nRelated work\n{TEXT}\nThe notice period is one month.\nResults are shown."),
        (f"<div class=post><div><p>The lead of the article stands first.</p></div><div>{BODY}</div><div><p>And this is the last paragraph.</p></div></div>", f"The lead of the article stands first.\n{TEXT}\nAnd this is the last paragraph."),
        (f"<div id=page><div>An intro to the whole text is here.</div><div>{BODY}</div><p>A closing paragraph ends it.</p></div>", f"An intro to the whole text is here.\n{TEXT}\nA closing paragraph ends it."),
        (f"<article>{BODY}</article><!-- unclosed <p>More words here to see.", TEXT),
        (f'<div class="comments">{BODY}</div>', TEXT),
        ("<main>" + "".join(f'<div class="post"><p>Text of post {k} stands here and is long enough.</p></div>' for k in range(8)) + "</main>", "\n".join(f"Text of post {k} stands here and is long enough." for k in range(8))),
    ],
)
def test_nothing_else_is_lost(html, text):
    assert html_text.main_text(f"<html><body><nav><a>x</a></nav>{html}") == text


def test_marked_pages_are_recalled():
    """Made-up pages whose article is known: nearly all of its words are found, and nearly nothing else."""
    r = random.Random(8)
    found = wanted = right = 0
    for _ in range(60):
        article = [sentence(r, r.randint(12, 80)) + "." for _ in range(r.randint(2, 9))]
        junk = [
            "<nav><ul>" + "".join(f"<li><a href=x>{sentence(r, 2)}</a></li>" for _ in range(8)) + "</ul></nav>",
            f'<div class="sidebar"><h3>More</h3><p>{sentence(r, 9)}</p></div>',
            f"<footer><p>{sentence(r, 8)}</p></footer>",
            f'<div id="comments"><p>{sentence(r, 12)}</p></div>',
            f"<script>{sentence(r, 30)}</script>",
            "<div>" + "".join(f"<a href=x>{sentence(r, 1)}</a>" for _ in range(6)) + "</div>",
        ]
        inner = "".join(f"<p>{p}</p>" if r.random() < 0.8 else f"<ul><li>{p}</li></ul>" for p in article)
        wrap = r.choice([f"<article>{inner}</article>", f"<div class=post>{inner}</div>", f"<main><div>{inner}</div></main>", f"<table><tr><td>{inner}</td></tr></table>"])
        got_ = html_text.main_text("<html><body>" + junk[0] + junk[5] + wrap + "".join(r.sample(junk[1:5], 3)) + "</body></html>").split("\n")
        both = collections.Counter(got_) & collections.Counter(article)
        size = lambda x: sum(len(t) for t in x)
        found, wanted, right = found + size(got_), wanted + size(article), right + size(both.elements())
    assert right >= 0.98 * wanted and right >= 0.95 * found


def test_long_pages_are_read_whole():
    p = "Words of a very long paragraph. " * 20
    assert html_text.main_text("<body><div>" + f"<p>{p}</p>" * 4000 + "</div></body>").count("\n") == 3999


def test_pages_keep_their_rows(spark):
    out = html_text.extract(spark.createDataFrame([(1, "u", "<p>Text</p>", "p", "d", 1, 1), (1, "u", None, "p", "d", 1, 1), (None, None, "<p>é", "p", "d", 1, 1)], PAGES))
    assert got(out, "page_id", "url", "text", "n_chars") == collections.Counter([(1, "u", "Text", 4), (1, "u", "", 0), (None, None, "é", 1)])


# -- quality -----------------------------------------------------------------------------------------


def test_measures(docs):
    def measure(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) for j in range(8) if runs[tuple(w[k : k + 8])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)

    assert got(quality.report(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter(measure(*x) for x in texts())


def test_the_fit_tells_good_from_bad():
    counts = {"++++": 900, "+++0": 40, "-+++": 50, "-0++": 8, "0000": 5}
    model = quality.fit(counts, 4)
    assert model.posterior("++++") > 0.9 > 0.5 > model.posterior("-+++")
    assert quality.fit({}, 4).posterior("0000") == pytest.approx(0.9)


def test_the_fit_equals_plain_expectation_maximisation():
    """Text by text, with a table of rates for each class and rule, instead of counts of patterns."""
    r = random.Random(21)
    rows = []
    for _ in range(600):
        fine = r.random() < 0.8
        rows.append("".join("0" if r.random() < 0.2 else "-" if r.random() < (0.03 if fine else 0.6) else "+" for _ in range(5)))
    model = quality.fit(dict(collections.Counter(rows)), 5)
    cast = np.array([[v != "0" for v in x] for x in rows])
    bad = np.array([[v == "-" for v in x] for x in rows])
    rates, prior = np.array([[0.002] * 5, [0.2] * 5]), 0.9
    for _ in range(50):
        odds = [np.log(p) + (np.where(bad, np.log(q), np.log(1 - q)) * cast).sum(axis=1) for p, q in zip((prior, 1 - prior), rates, strict=True)]
        post = 1 / (1 + np.exp(odds[1] - odds[0]))
        for k, (w, first, made_up) in enumerate(((post, 0.002, 20), (1 - post, 0.2, 1))):
            rates[k] = ((w[:, None] * bad).sum(axis=0) + made_up * first) / ((w[:, None] * cast).sum(axis=0) + made_up)
        rates[:, rates[0] > rates[1]] = rates.mean(axis=0)[rates[0] > rates[1]]
        rates, prior = rates.clip(0.001, 0.999), float(np.clip(post.mean(), 0.001, 0.999))
    odds = [np.log(p) + (np.where(bad, np.log(q), np.log(1 - q)) * cast).sum(axis=1) for p, q in zip((prior, 1 - prior), rates, strict=True)]
    assert [model.posterior(x) for x in rows] == pytest.approx((1 / (1 + np.exp(odds[1] - odds[0]))).tolist())
    assert [model.given_good[k]["-"] for k in range(5)] == pytest.approx(rates[0].tolist())


def test_junk_goes_and_clean_texts_stay(spark):
    r = random.Random(6)
    clean = [(k, sentence(r, 80)) for k in range(40)]
    junk = [(100 + k, " ".join(w + "###" for w in sentence(r, 80).split())) for k in range(6)]
    kept = {x.doc_id for x in quality.keep_good(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in clean}


# -- licences ------------------------------------------------------------------------------------------

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


@pytest.mark.parametrize(
    "text,found",
    [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + THIRD, "BSD-3-Clause"), ("Text. Released under the MIT License. More text.", "MIT"), ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,all-rights-reserved"), ("no licence here", ""), (None, "")],
)
def test_licences(spark, text, found):
    assert licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == found


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text,found",
    [
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + "\n\n".join(textwrap.fill(x, 76) for x in MIT.split("\n")), "MIT"),
        ("\n".join(textwrap.fill(x, 74, subsequent_indent="   ") for x in (BSD + THIRD).split("\n")), "BSD-3-Clause"),
        (textwrap.fill(GPL, 72, initial_indent=" * ", subsequent_indent=" * "), "GPL-3.0-or-later"),
        ("This project is released under the MIT License.", "MIT"), ("MIT License", "MIT"), ("The MIT License (MIT)\nCopyright (c) 2020 X", "MIT"), ("X\nMIT License\r\nCopyright X", "MIT"),
        ("We compare it with the MIT License here.", ""), ("It is not licensed under the MIT License.", ""),
    ],
)
def test_wrapped_licences_and_notices_in_sentences(spark, text, found):
    assert licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("// SPDX-License-Identifier: MIT\n#include <a.h>", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.", ["ISC"]),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0-or-later"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", ["Apache-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not given, ask.", ["MPL-2.0"]),
        ("Software without a licence sentence of its own, and its permissions.", []),
    ],
)
def test_more_licences(spark, text, found):
    df = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert list(df.first()[licenses.P + "found"]) == found


def plainly_scanned(text):
    """Known sentences and licences by loops over all of them at every place."""
    table = {s: k for k, s in licenses.SENTENCES.items()} | licenses.TITLES
    known = []
    for i, part in enumerate(regex.split(licenses.SENTENCE_END, text)):
        s = re.sub("[^a-z0-9]+", " ", low(part)).strip(" ")
        s = re.sub(r"^(?:[0-9]{1,2} |[a-z] )(?=redistributions |neither )", "", s)
        if s in table:
            known.append((i, table[s]))
            continue
        words, k = s.split(" "), 0
        while k < len(words):
            fits = [x for x in licenses.SENTENCES.values() if x not in licenses.TITLES and words[k : k + len(x.split())] == x.split() and (k == 0 or words[k - 1] != "not")]
            if fits:
                best = max(fits, key=len)
                known.append((i, table[best]))
                k += len(best.split())
            else:
                k += 1
    ids, found, k = [x for _, x in known], [], 0
    while k < len(ids):
        rule = next(((name, seq) for name, seq in licenses.RULES if tuple(ids[k : k + len(seq)]) == seq), None)
        if rule:
            found.append(rule[0])
        k += len(rule[1]) if rule else 1
    return known, found


def test_licences_are_those_of_plain_loops(spark):
    r = random.Random(10)
    pieces = [*licenses.SENTENCES.values(), *licenses.TITLES, "not", "some other words", "2", "a"]
    rows = [(k, "".join(r.choice([str.upper, str.title, str])(r.choice(pieces)) + r.choice([". ", " ", "\n", "\n\n", "; ", ", ", "!\n"]) for _ in range(r.randint(0, 9)))) for k in range(250)] + [(999, "word " * 50_000 + licenses.SENTENCES["mit-notice"])]
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        known, found = plainly_scanned(x["text"])
        assert ([(v["at"], v["id"]) for v in x[licenses.P + "known"]], list(x[licenses.P + "found"])) == (known, found)


def test_every_known_sentence_has_a_word_that_opens_texts():
    assert all(any(w in s for w in licenses.WORDS) for s in [*licenses.SENTENCES.values(), *licenses.TITLES])


def test_licences_of_odd_rows(docs):
    assert licenses.report(docs).count() == len(texts())
    assert json.dumps(licenses.RULES)
    assert all(s in licenses.SENTENCES for _, seq in licenses.RULES for s in seq)


def test_rows_of_one_number_are_copied_and_others_added():
    """The sums are those of adding every number's rows, to the last bit, for numbers of any size."""
    import numpy as np

    r = np.random.default_rng(3)
    for n, most in ((1, 5), (257, 40), (1024, 20000), (1024, 1 << 30)):
        g, rows = r.random((n, 4), np.float32), r.integers(0, most, n).astype(np.int32)
        by = np.argsort(rows, kind="stable")
        numbers, first = np.unique(rows[by], return_index=True)
        at, total = maxent.summed(g, rows)
        assert np.array_equal(at, numbers) and np.array_equal(total, np.add.reduceat(g[by], first, axis=0))
