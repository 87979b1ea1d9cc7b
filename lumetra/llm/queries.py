"""The registered queries of this subpackage and the SQL that states the same results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, filter_audit, fingerprint, html_extract, jaccard_join, line_dedup, packing, ranked_search, substring_dedup, suffix_dedup, toxicity, url_filter
from .storage import cleanup  # noqa: F401
from .text import utf8_sha256


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what near-duplicate line removal leaves of it."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.length("text").cast("long").alias("n_chars_kept"), utf8_sha256(F.col("text")).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words inside benchmark windows."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its main text."""
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document its sequence and offset."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the verdict on its URL."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation what its formatted examples give back."""
    return chat_format.digests(_read(spark, sf_dir, "conversations"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what removing repeated 400-byte strings leaves of it."""
    out = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness."""
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its toxicity score."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its shingle count and its component of near copies."""
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what removing passages of smaller documents leaves of it."""
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", utf8_sha256(F.col("kept")).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by source."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_decontamination, op3_html_extraction, op4_best_fit_packing, op5_url_filter, op6_chat_format, op7_suffix_dedup, op8_document_fingerprints, op9_toxicity,
    op10_ngram_jaccard_join, op11_substring_dedup, op12_ranked_search, op13_filter_audit,
)}

#: Windows and documents as lists of words; a window counts where its words stand one after the other.
_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, width, array_to_string(w[i:i + width - 1], ' ') AS win FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM bw))),
h AS (SELECT rid, i, dw.width, item FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

#: Examples of a conversation: every rendered turn up to each assistant turn.
_OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
e AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\l')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS size FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: All pairs that share a shingle, and the closure of the links.
_OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id
"""

#: Every window of 50 words with the smallest document that has it.
_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT rid, d, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM (SELECT rid, d, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
o AS (SELECT win, min(d) AS first FROM k GROUP BY win HAVING min(d) < max(d)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM k JOIN o USING (win) WHERE d > first),
x AS (SELECT d.rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
g AS (SELECT x.rid, count(*) FILTER (c.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c ON c.rid = x.rid AND c.p = x.p GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (rid)
"""

#: Every document's score for every item.
_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
c AS (SELECT item_id, rid, CAST(sum(times * CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (rid), s GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c JOIN d USING (rid) WHERE score > 0 QUALIFY rank <= 20
"""

#: Every document in every order.
_OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
r AS (SELECT row_number() OVER () AS rid, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails FROM t LEFT JOIN l USING (doc_id)),
u AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM u a, u b, u c, u d, u e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT *, list_min([strpos(filter_order, y) FOR y IN string_split(fails, '') IF y <> '']) AS hit FROM g, o),
st AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS "filter", sum(n) FILTER (hit IS NULL OR hit > step) AS kept, sum(n) FILTER (hit = step) AS removed,
  sum(n) FILTER (hit < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
  sum(n) FILTER (hit = step AND good) AS good_lost, sum(n) FILTER (hit = step AND toxic) AS toxic_lost FROM h, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, "filter", CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, "filter"), 0) AS BIGINT) AS shapley FROM st
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": _OP2_SQL, "op6_chat_format": _OP6_SQL, "op10_ngram_jaccard_join": _OP10_SQL, "op11_substring_dedup": _OP11_SQL, "op12_ranked_search": _OP12_SQL, "op13_filter_audit": _OP13_SQL,
}
