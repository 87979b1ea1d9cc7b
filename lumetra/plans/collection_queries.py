"""Queries over collected portals, reference lists, attributes of found records and nearest rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crawl, gazetteer, linkage, metrics
from ..sources import tables
from ..sources.shared import shared_dir
from ..sources.tables import table
from .linkage_queries import _COS, _GOLD, _LINKED, _gold, _halves, _linked
from .registry import query

_HOST = r"^[a-z]+://[^/?#]*?([a-z]+\.[a-z]+)(?:[/?#]|$)"


def _listings(spark, d):
    """Listing pages of twenty articles a site; a page repeats the links of the page before, as growing listings do."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", _HOST, 1).alias("portal"), F.expr("CAST(page_id div 20 AS INT)").alias("n"), "url", "page_id")
    links = p.withColumn("page_number", F.explode(F.array("n", F.col("n") + 1)))
    anchors = F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "url", F.lit('">more</a>'))))  # at most forty
    html = F.concat(F.lit("<main>"), F.array_join(anchors, ""), F.lit("</main>"))
    return links.groupBy("portal", "page_number").agg(html.alias("html")).withColumn("base", F.concat(F.lit("https://"), "portal"))


@query(rf"""WITH p AS (SELECT regexp_extract(url, '{_HOST}', 1) AS portal, CAST(page_id // 20 AS INTEGER) AS page_number, regexp_extract(url, '^[^?#]*') AS link, page_id, html FROM pages),
f AS (SELECT link, arg_min(html, page_id) AS html FROM p GROUP BY 1), l AS (SELECT portal, link, min(page_number) AS page_number FROM p WHERE starts_with(link, 'http') AND NOT contains(link, '/de/') GROUP BY 1, 2)
SELECT portal, link AS url, page_number, html IS NOT NULL AS fetched,
coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')), ''), 'sem-titulo') AS title,
array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content
FROM l JOIN f USING (link)""")
def collected_articles(spark, d):
    """Listing pages, their links, each URL once, and the articles behind them."""
    articles = table(spark, d, "pages").select(F.regexp_extract("url", r"^[^?#]*", 0).alias("url"), F.col("page_id").alias("number"), "html")
    return crawl.collect_portal(_listings(spark, d), articles, "main", ["http"], ["/de/"])


_OPENING = r"^\p{L}{2,} \p{L}{2,}"


@query(rf"""WITH r AS (SELECT DISTINCT lower(regexp_extract(text, '{_OPENING}')) AS name FROM benchmark WHERE regexp_matches(text, '{_OPENING}'))
SELECT name, count(doc_id) AS documents, min(doc_id) AS first_doc FROM r LEFT JOIN documents ON contains(lower(text), name) AND regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || name || '($|[^\p{{L}}\p{{N}}_])') GROUP BY 1""")
def reference_matches(spark, d):
    """Documents that hold each name of a reference list, which is read from saved JSON answers."""
    folder = f"{shared_dir(spark)}/reference-{uuid.uuid4().hex}"
    answers = table(spark, d, "benchmark").select(F.expr("item_id div 100").alias("page"), F.struct(F.regexp_extract("text", _OPENING, 0).alias("nome")).alias("x"))
    answers.groupBy("page").agg(F.to_json(F.collect_list("x")).alias("value")).select("value").write.text(folder)  # an answer has a hundred names
    names = tables.read_reference_list(spark, folder, "nome", lines=True)
    found = gazetteer.whole_word_matches(table(spark, d, "documents"), names)
    counts = found.groupBy("name").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return names.join(counts, "name", "left").select("name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), "first_doc")


_ATTRIBUTES = ["lang", "source", "long_text", "opening"]
_ATTRIBUTE_SQL = {"lang": "{0}.lang", "source": "{0}.source", "long_text": "{0}.n_chars >= 2000", "opening": "lower(substr({0}.text, 1, 1))"}


@query(f"""{_LINKED}, {_GOLD}, first AS (SELECT query_id, min(doc_id) AS doc_id FROM gold GROUP BY 1),
x AS (SELECT {", ".join(f"CASE WHEN ({_ATTRIBUTE_SQL[a].format('g')}) IS NOT DISTINCT FROM ({_ATTRIBUTE_SQL[a].format('b')}) THEN 1.0::DOUBLE ELSE 0 END AS {a}" for a in _ATTRIBUTES)}
FROM first JOIN top ON top.query_id = first.query_id AND top.rank = 1 JOIN documents g ON g.doc_id = first.doc_id JOIN documents b ON b.doc_id = top.doc_id),
y AS ({" UNION ALL ".join(f"SELECT '{a}' AS attribute, count(*) AS rows, avg({a}) AS share FROM x" for a in _ATTRIBUTES)})
SELECT attribute, rows, round(share, 6) AS accuracy, round((SELECT avg(share) FROM y), 6) AS macro_accuracy FROM y""")
def attribute_accuracy(spark, d):
    """How often the first linked document has the gold document's attributes, and their macro mean."""
    docs = table(spark, d, "documents")
    of = F.struct("lang", "source", (F.col("n_chars") >= 2000).alias("long_text"), F.lower(F.substring("text", 1, 1)).alias("opening"))
    gold = _gold(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).join(docs.select("doc_id", of.alias("gold")), "doc_id").drop("doc_id")
    found = _linked(spark, d, 1).select("query_id", "doc_id").join(docs.select("doc_id", of.alias("found")), "doc_id").drop("doc_id")
    return metrics.attribute_accuracy(gold.join(found, "query_id"), _ATTRIBUTES)


@query(f"""SELECT a, b, cos, CAST(row_number() OVER (ORDER BY cos DESC, a) AS INTEGER) AS rank FROM (SELECT a.vec_id AS a, arg_max(b.vec_id, {_COS} - b.vec_id * 1e-12::DOUBLE) AS b, max({_COS}) AS cos
FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY 1) QUALIFY rank <= 10""")
def nearest_overall(spark, d):
    """The ten test vectors nearest to any train vector."""
    return linkage.nearest_overall(*_halves(spark, d))


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, '') || ' ' || coalesce(text, '')) AS joined FROM documents")
def title_and_text(spark, d):
    """Two columns in one, some of the first null."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.title_and_text(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.col("text"))).alias("joined"))
