"""Registered corpus queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, langid, licenses, merkle, mixing, packing, quality, repair, simple8b, substrings, topk, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (
  SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN cov ON l.doc_id = cov.doc_id),
b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (100 * n_symbols > 30 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_bits,
       rule_bits & 3 <> 0 AS base_failed, rule_bits = 0 AS kept, 'v2' AS policy
FROM b
"""


@_query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def _op10_sql() -> str:
    known = ", ".join(f"('{licenses.normalised(s)}', '<{i}>')" for i, s in licenses.SENTENCES.items())
    steps, prev = [], "c0"
    for k, (name, ids) in enumerate(licenses.LICENCE_RULES, 1):
        seq = licenses._sequence(ids)
        steps.append(
            f"c{k} AS (SELECT * REPLACE (CASE WHEN contains(rest, '{seq}') THEN replace(rest, '{seq}', '|') ELSE rest END AS rest, "
            f"CASE WHEN contains(rest, '{seq}') THEN list_append(hits, '{name}') ELSE hits END AS hits) FROM {prev})")
        prev = f"c{k}"
    return r"""
WITH known(s, code) AS (VALUES """ + known + r"""),
t AS (
  SELECT doc_id, string_split_regex(
    regexp_replace(lower(coalesce(text, '')), '([.!?:])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), '\n+') AS p
  FROM documents),
f AS (SELECT doc_id, list_filter(p, lambda x: regexp_matches(x, '[a-z0-9]')) AS p FROM t),
e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM f),
g AS (
  SELECT e.doc_id, count(*) AS n_known, string_agg(code, '' ORDER BY i) AS seq
  FROM e JOIN known ON known.s = trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) GROUP BY e.doc_id),
c0 AS (
  SELECT f.doc_id, CAST(len(p) AS BIGINT) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
         coalesce(seq, '') AS sentence_ids, coalesce(seq, '') AS rest, CAST([] AS VARCHAR[]) AS hits
  FROM f LEFT JOIN g ON f.doc_id = g.doc_id),
""" + ",\n".join(steps) + f"""
SELECT doc_id, n_sentences, n_known, sentence_ids, array_to_string(hits, ',') AS licences,
       CAST(len(hits) AS BIGINT) AS n_licences
FROM {prev}
"""


@_query("op10_license_scan", _op10_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


@_query("op6_token_ids_binary")
def op6_token_ids_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.id_files(spark, table(spark, sf_dir, "documents"))


@_query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op8_exact_top_k", OP8_SQL)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


@_query("op2_warc_round_trip", OP2_SQL)
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@_query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.cut_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = w.doc_id
"""


@_query("op3_ngram_jaccard_join", OP3_SQL)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _crc_table() -> str:
    """CTE crc(tab): the 256 entries of CRC-32, by eight steps each."""
    x = "SELECT i, i AS v FROM (SELECT unnest(range(0, 256)) AS i)"
    for _ in range(8):
        x = f"SELECT i, xor(v >> 1, (v & 1) * 3988292384) AS v FROM ({x})"
    return f"crc AS (SELECT list(v ORDER BY i) AS tab FROM ({x}))"


def _crc(text: str) -> str:
    """CRC-32 of an ASCII string, next to the table ``crc``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")


def _op11_sql() -> str:
    # a state is its least cost in 8 digits and its least audit, or null
    more = lambda s, w, e: f"(lpad(CAST(CAST(substr({s}, 1, 8) AS INT) + {w} AS VARCHAR), 8, '0') || substr({s}, 9) || '{e}')"  # noqa: E731
    inserts = (f"least(s2, {more('s0', 2, 'I')}, {more('s1', 2, 'I')}, {more('s3', 2, 'I')}) AS t2")
    t = f"(SELECT *, least(s3, {more('t2', 2, 'I')}) AS t3 FROM (SELECT *, {inserts} FROM dp))"
    stay = lambda s, ini, e, w: f"CASE WHEN NOT gone{ini and f' AND c = ' + repr(ini)} THEN {more(s, w + ' + cut', e)} END"  # noqa: E731
    from_any = lambda ini, e, w: ", ".join(stay(s, ini, e, w) for s in ("s0", "s1", "t3"))  # noqa: E731
    return r"""
WITH RECURSIVE """ + _crc_table() + r""",
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         """ + _crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + r""" % 20 AS kind
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (SELECT unnest(range(0, 2)) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
r0 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         NOT regexp_matches(text, '[^ 	-]') AS blank,
         CAST(NOT regexp_matches(text, '[.!?][ 	-]*$') AS INT) AS cut, substr(role, 1, 1) AS c
  FROM d),
r AS (
  SELECT *, blank OR dup AS gone, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM (
    SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM r0)),
st AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (NOT gone AND cut = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM st
  UNION ALL
  SELECT t.conv_id, t.n, r.i, """ + more("s0", 3, "D") + r""",
         least(""" + more("s1", 3, "D") + ", " + stay("s0", "s", "K", "0") + r"""),
         least(""" + more("t2", 3, "D") + ", " + from_any("u", "K", "0") + ", " + from_any("", "R", "2") + r"""),
         least(""" + more("t3", 3, "D") + ", " + stay("t2", "a", "K", "0") + ", " + stay("t2", "", "R", "2") + r""")
  FROM """ + t + r""" t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1),
best AS (SELECT conv_id, least(s0, t3) AS s FROM """ + t + r""" WHERE i = n),
a AS (SELECT conv_id, CAST(substr(s, 1, 8) AS BIGINT) AS cost, substr(s, 9) AS audit FROM best),
e AS (
  SELECT conv_id, audit, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS j FROM a WHERE audit <> ''),
p AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i,
         count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) - count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS o
  FROM e),
l AS (
  SELECT p.conv_id, sha256(string_agg(
    CASE WHEN e = 'K' THEN role WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h
  FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE e <> 'D' GROUP BY p.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@_query("op11_conversation_repair", _op11_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def _op12_sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """Levels are unrolled: sources of up to 16^5 rows, 16^4 sources."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"  # noqa: E731
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"  # noqa: E731
    same = "IS NOT DISTINCT FROM"

    def level(k: int, rows: str, name: str, tree: str) -> str:
        # nodes of one level with the siblings before and after them and their parent
        w = f"PARTITION BY {tree}, i // 16 ORDER BY i"
        return f"""
{name} AS (
  SELECT *, CASE WHEN m > 1 THEN coalesce(string_agg(node, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS before,
         CASE WHEN m > 1 THEN coalesce(string_agg(node, '') OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS after,
         CASE WHEN m > 1 THEN sha256(string_agg(node, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE node END AS up
  FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS m FROM ({rows})))"""
    parts = []
    for k in range(source_levels):
        rows = ("SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS i, node, doc_id, other FROM leaves" if k == 0
                else f"SELECT DISTINCT source, i // 16 AS i, up AS node FROM s{k - 1}")
        parts.append(level(k, rows, f"s{k}", "source"))
    for k in range(top_levels):
        last = f"s{source_levels - 1}"
        rows = (f"SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, up AS node, 0 AS one FROM (SELECT DISTINCT source, up FROM {last})" if k == 0
                else f"SELECT DISTINCT i // 16 AS i, up AS node, 0 AS one FROM t{k - 1}")
        parts.append(level(k, rows, f"t{k}", "one"))
    joins, sibs, fold = "", "s0.before || s0.after", "coalesce(s0.other, s0.node)"
    step = lambda x, f: f"CASE WHEN {x}.m > 1 THEN sha256({x}.before || {f} || {x}.after) ELSE {f} END"  # noqa: E731
    cols = [f"{step('s0', fold)} AS f0"]
    for k in range(1, source_levels):
        joins += f" JOIN s{k} ON s{k}.source {same} s0.source AND s{k}.i = s0.i // {16 ** k}"
    joins += f" JOIN t0 ON t0.source {same} s0.source"
    for k in range(1, top_levels):
        joins += f" JOIN t{k} ON t{k}.i = t0.i // {16 ** k}"
    chain = [f"s{k}" for k in range(source_levels)] + [f"t{k}" for k in range(top_levels)]
    sibs = " || ".join(f"{x}.before || {x}.after" for x in chain)
    paths = ", ".join(f"{x}.m AS m{n}, {x}.before AS b{n}, {x}.after AS a{n}" for n, x in enumerate(chain))
    folds, f = "", f"SELECT *, coalesce(other, leaf) AS f FROM path"
    for n in range(len(chain)):
        f = f"SELECT * REPLACE (CASE WHEN m{n} > 1 THEN sha256(b{n} || f || a{n}) ELSE f END AS f) FROM ({f})"
    return f"""
WITH {_crc_table()},
leaves AS (
  SELECT source, doc_id, {leaf('text')} AS node,
         CASE WHEN doc_id IS NOT NULL AND {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS other
  FROM documents, crc),{",".join(parts)},
path AS (
  SELECT s0.doc_id, s0.node AS leaf, s0.other, t0.node AS subroot, t{top_levels - 1}.up AS root, sha256({sibs}) AS proof_sha256, {paths}
  FROM s0{joins})
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM ({f})
"""


@_query("op12_merkle_manifest", _op12_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def _op13_sql(rounds: int = mixing.ROUNDS) -> str:
    rank = "xi, h, doc_id NULLS FIRST"
    steps = []
    for k in range(rounds):
        prev = f"w{k - 1}" if k else "w"
        fits = f"xi IS NOT NULL AND size > 0 AND size <= open{k} AND pos > low{k}"
        steps.append(f"""
x{k} AS (SELECT *, {fits} AS fits, coalesce(sum(CASE WHEN {fits} THEN size END) OVER (PARTITION BY source ORDER BY pos), 0) AS cum FROM {prev}),
w{k} AS (
  SELECT * EXCLUDE (fits, cum, extra), CASE WHEN fits AND cum <= open{k} THEN 1 ELSE extra END AS extra,
         open{k} - coalesce(sum(CASE WHEN fits AND cum <= open{k} THEN size END) OVER (PARTITION BY source), 0) AS open{k + 1},
         coalesce(min(CASE WHEN fits AND cum > open{k} THEN pos END) OVER (PARTITION BY source), 1000000000000000000) AS low{k + 1}
  FROM x{k})""")
    return r"""
WITH d AS (
  SELECT source, doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s0),
-- sources in the order in which they stop; level: words to a unit of weight when all before have stopped
s2 AS (
  SELECT *, row_number() OVER o AS k, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS words,
         CAST(2 * (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE) AS units
  FROM s1 WINDOW o AS (ORDER BY 6 * source_size // weight, source NULLS LAST)),
s3 AS (
  SELECT *, coalesce(min(CASE WHEN 2 * source_size > words * weight / units THEN k END) OVER (), 1000000000000000000) AS stop,
         words AS w0, units AS u0 FROM s2),
s4 AS (SELECT *, max(CASE WHEN k = stop THEN words END) OVER () AS w1, max(CASE WHEN k = stop THEN units END) OVER () AS u1 FROM s3),
src AS (
  SELECT source, source_size, CASE WHEN k < stop THEN CAST(2 * source_size AS DOUBLE) ELSE w1 * weight / u1 END AS target FROM s4),
c AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
q AS (SELECT *, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS p, (h + 0.5) / 4503599627370496.0 AS u FROM c),
z AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS xi FROM q),
w AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY """ + rank + r""") AS pos, 0 AS low0, 0 AS extra,
         target - sum(certain * size) OVER (PARTITION BY source) AS open0 FROM z),""" + ",".join(steps) + f"""
SELECT doc_id, size, source_size, target, CAST((certain + extra) * size AS BIGINT) AS taken FROM w{rounds - 1}
"""


@_query("op13_source_mix", _op13_sql())
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
