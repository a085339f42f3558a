"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeweave.llm import conversation, decontam, exact_dedup, html_text, licenses, maxent, near_dup, packing, pii, quality, resample, suffix_dedup, text, warc
from ridgeweave.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered personal data of every document."""
    return pii.report(read_table(spark, sf_dir, "documents"))


@query
def op7_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = quality.report(read_table(spark, sf_dir, "documents"))
    return out.drop("votes", "posterior")


@query
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document states."""
    return licenses.report(read_table(spark, sf_dir, "documents"))


@query
def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


ORACLES["op3_warc_salvage"] = """
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN strlen(body) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


@query
def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates, on shingles of two words."""
    return near_dup.link(read_table(spark, sf_dir, "documents"), near_dup.Forest(words=2))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a smaller doc_id has."""
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


ORACLES["op2_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i FROM w JOIN f USING (s) WHERE least < doc_id),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut),
runs AS (SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS low, low AS high FROM runs
         UNION ALL SELECT doc_id, coalesce(max(high), 1), any_value(octet_length(b)) + 1 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, unhex(string_agg(CASE WHEN high > gaps.low THEN hex(b[gaps.low:high - 1]) ELSE '' END, '' ORDER BY gaps.low)) AS rest FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(rest) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""


@query
def op5_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by unigrams and by the model."""
    return maxent.score(read_table(spark, sf_dir, "documents"))


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLES["op7_prefix_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format(text.LETTER_WORDS)} AS w FROM benchmark),
bw AS (SELECT item, CASE WHEN len(w) <= 10 THEN w ELSE w[i:i + 9] END AS win, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS.format(text.LETTER_WORDS)} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) r(k) WHERE k < n GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op6_lsh_forest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text.BLANK_WORDS)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 1) + 1)) AS i FROM d)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT doc_id, b FROM reach JOIN link ON other = a)
SELECT d.doc_id, CAST(coalesce(max(z.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(min(other), d.doc_id)) AS kept
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY 1
"""


@query
def op11_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact_dedup.report(read_table(spark, sf_dir, "documents"))


ORACLES["op11_content_sort_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""

#: CRC-32 in SQL: the table from its polynomial, then one step for each byte of a text.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab"


def crc(text: str) -> str:
    """SQL of an ASCII or UTF-8 text's CRC-32, where ``tab`` is the table."""
    pairs = f"list_transform(range(CAST(length(hex({text})) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planned damage."""
    rows = read_table(spark, sf_dir, "conversations")
    return conversation.report(conversation.damaged(rows), rows)


def repair_sql() -> str:
    """A fold over each conversation's rows; a state's key is its cost in nine digits and then its audit."""

    def edit(x: str, cost: str, letter: str, piece: str | None) -> str:
        k = f"lpad(CAST(CAST(left({x}.k, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}.k, 10) || '{letter}'"
        r = f"{x}.r" if piece is None else f"{x}.r || CASE WHEN {x}.r = '' THEN '' ELSE chr(10) END || {piece}"
        return f"{{'k': {k}, 'r': {r}}}"

    def least(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda o: o.k IS NOT NULL))"

    nothing = "CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR))"
    drop = lambda q: edit(f"st.{q}", "4", "D", None)
    keep = lambda q, initial: f"CASE WHEN e.fault NOT IN (1, 2) AND e.initial = '{initial}' THEN {edit(f'st.{q}', 'e.charge', 'K', 'e.line')} ELSE {nothing} END"
    turn = lambda q, role: f"CASE WHEN e.fault NOT IN (1, 2) THEN {edit(f'st.{q}', '3 + e.charge', 'R', chr(39) + role + ':' + chr(39) + ' || e.body')} ELSE {nothing} END"
    insert = lambda q, role: edit(f"st.{q}", "3", "I", f"'{role}:'")
    row = {
        "z": least(drop("z")),
        "s": least(drop("s"), keep("z", "s")),
        "u": least(drop("u"), *[keep(q, "u") for q in "zsa"], *[turn(q, "user") for q in "zsa"]),
        "a": least(drop("a"), keep("u", "a"), turn("u", "assistant")),
    }
    pack = lambda **new: "{" + ", ".join(f"'{q}': {new.get(q, f'st.{q}')}" for q in "zsua") + "}"
    step = f"CASE e.op WHEN 1 THEN {pack(**row)} WHEN 2 THEN {pack(u=least('st.u', *[insert(q, 'user') for q in 'zsa']))} ELSE {pack(a=least('st.a', insert('u', 'assistant')))} END"
    start = f"{{'z': {{'k': '000000000', 'r': ''}}, 's': {nothing}, 'u': {nothing}, 'a': {nothing}}}"
    pause = "{'op': 2, 'initial': '', 'fault': 0, 'charge': 0, 'line': '', 'body': ''}, {'op': 3, 'initial': '', 'fault': 0, 'charge': 0, 'line': '', 'body': ''}"
    return f"""
WITH t AS ({CRC_TABLE}),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS die FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN die = 4 THEN 'user' WHEN role = '' THEN ' ' ELSE role END AS role, CASE die WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN die = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE die <> 0),
k AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS place FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM k),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'op': 1, 'initial': initial, 'fault': fault, 'charge': CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'line': role || ':' || text, 'body': text}} ORDER BY place) AS steps FROM f GROUP BY conv_id),
s AS (SELECT * EXCLUDE (steps), list_reduce([{pause}] || flatten(list_transform(steps, lambda x: [x, {pause}])), lambda st, e: {step}, {start}) AS st FROM g),
b AS (SELECT * EXCLUDE (st), {least("st.z", "st.a")} AS best FROM s)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(CAST(left(best.k, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLES["op12_conversation_repair"] = repair_sql()


@query
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's words."""
    return resample.draw(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_draw"] = f"""
WITH t AS ({CRC_TABLE}),
d AS (SELECT doc_id, {WORDS.format(text.LETTER_WORDS)} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS f FROM d),
bw AS (SELECT unnest({WORDS.format(text.LETTER_WORDS)}) AS f FROM benchmark),
v AS (SELECT f, CAST({crc("f")} % 10000 AS INTEGER) AS bucket FROM (SELECT f FROM dw UNION SELECT f FROM bw), t),
sn AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (f) GROUP BY 1),
tn AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (f) GROUP BY 1),
g AS (SELECT f, CAST(floor(1000 * ln(CAST(coalesce(tn.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM sn) + 10000 AS DOUBLE) / (CAST(coalesce(sn.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM tn) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
      FROM v LEFT JOIN sn USING (bucket) LEFT JOIN tn USING (bucket)),
m AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN g USING (f) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM r
"""
