"""Queries over a linkage run's evaluation, small relational steps, listings and model reports.

Order lines stand for a run's candidates (an order is a query, its line number the rank, the part the document),
the dearest line is gold, and answers follow from the order key; the SQL states each step by its own means.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import crawl, reports, split
from ..operators import evaluation as E
from ..sources.shared import shared_dir
from ..sources.tables import digest, header_of, read_csv, read_json_records, replace_checked, table, url_tail, write_json_records, write_metrics, write_ordered, write_parquet_checked
from .registry import query

_RUN = """c AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_partkey AS doc_id, l_extendedprice AS score FROM lineitem),
g AS (SELECT DISTINCT query_id, doc_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c) WHERE score = top),
a AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 11 = 10 THEN -1 ELSE o_orderkey % 11 - 2 * (o_orderkey % 2) END AS answer FROM orders WHERE o_orderkey % 13 <> 0)"""
_OUT = """r AS (SELECT q.query_id, coalesce(max(n), 0) AS candidates, min(CASE WHEN h.query_id IS NOT NULL THEN rank END) AS gold_rank FROM (SELECT DISTINCT query_id FROM g) q LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c WHERE rank <= {top}) s ON s.query_id = q.query_id LEFT JOIN g h ON h.query_id = s.query_id AND h.doc_id = s.doc_id GROUP BY 1),
o AS (SELECT r.*, answer, CASE WHEN answer BETWEEN 1 AND candidates THEN 'chosen' WHEN answer = 0 THEN 'abstained' ELSE 'failed' END AS outcome, coalesce(answer BETWEEN 1 AND candidates AND answer = gold_rank, false) AS correct FROM r LEFT JOIN a USING (query_id))"""


def _run(spark, d):
    line = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cache = line.select(F.col("l_orderkey").alias("query_id"), F.row_number().over(w).alias("rank"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"))
    top = cache.groupBy("query_id").agg(F.max("score").alias("top"))
    gold = cache.join(top, "query_id").where("score = top").select("query_id", "doc_id").distinct()
    answers = table(spark, d, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("query_id"), F.expr("CASE WHEN o_orderkey % 11 = 10 THEN -1 ELSE o_orderkey % 11 - 2 * (o_orderkey % 2) END").alias("answer"))
    return cache, gold, answers


@query(f"""WITH {_RUN}, {_OUT.format(top=5)} SELECT count(*) AS queries, round(avg(CASE WHEN gold_rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS baseline_p1, round(avg(CASE WHEN gold_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_top,
count(*) FILTER (outcome = 'abstained') AS zeros, count(*) FILTER (outcome = 'failed') AS failures, count(*) FILTER (outcome = 'chosen') AS chosen, count(*) FILTER (correct) AS correct, round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
round(count(*) FILTER (correct AND gold_rank IS NOT NULL) / count(*) FILTER (gold_rank IS NOT NULL), 6) AS accuracy_with_candidates, round(round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END), 6) - round(avg(CASE WHEN gold_rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6), 6) AS gain FROM o""")
def canonical_evaluation(spark, d):
    """Baseline and choosing step of a run over one set of queries: outcomes, accuracies, gain."""
    return E.canonical(*_run(spark, d), top=5)


@query(f"""WITH {_RUN}, {_OUT.format(top=3)} SELECT outcome, CASE WHEN gold_rank IS NULL THEN 'not found' ELSE 'rank ' || gold_rank END AS gold_at, count(*) AS n FROM o WHERE NOT correct GROUP BY 1, 2""")
def error_breakdown(spark, d):
    """Wrong answers by outcome and the place of the gold document."""
    cache, gold, answers = _run(spark, d)
    o = E.outcomes(E.gold_ranks(cache, gold, 3), answers).where(~F.col("correct"))
    return o.groupBy("outcome", F.coalesce(F.concat(F.lit("rank "), F.col("gold_rank").cast("string")), F.lit("not found")).alias("gold_at")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RUN}, {_OUT.format(top=3)}, one AS (SELECT query_id, min(doc_id) AS gold_id FROM g GROUP BY 1)
SELECT o.query_id, outcome, gold_rank, gold_id, coalesce(pp.p_name, '') AS chosen_description, coalesce(gp.p_name, '') AS gold_description FROM o JOIN one USING (query_id) LEFT JOIN c ON c.query_id = o.query_id AND c.rank = o.answer AND c.rank <= 3
LEFT JOIN part pp ON pp.p_partkey = c.doc_id LEFT JOIN part gp ON gp.p_partkey = gold_id WHERE NOT correct""")
def error_enrichment(spark, d):
    """Wrong answers beside the chosen and the gold description, looked up in the candidates, then in the base."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("description"))
    cache, gold, answers = _run(spark, d)
    # a document can stand twice among a query's candidates; its description is the same
    return E.error_table(cache, gold, answers, base, top=3).distinct()


@query("""SELECT r.name, r.n, coalesce(b.n, 0) AS baseline, r.n - coalesce(b.n, 0) AS over FROM (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1) r LEFT JOIN (SELECT o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderpriority < '4' AND o_orderstatus = 'F' GROUP BY 1) b USING (name)""")
def baseline_lookup(spark, d):
    """Results beside the baseline of the same name, with 0 where there is none."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "name")
    r, b = o.groupBy("name").agg(F.count("*").alias("n")), o.where("name < '4' AND o_orderstatus = 'F'").groupBy("name").agg(F.count("*").alias("baseline"))
    return r.join(b, "name", "left").select("name", "n", F.coalesce("baseline", F.lit(0)).alias("baseline"), (F.col("n") - F.coalesce("baseline", F.lit(0))).alias("over"))


_RANKS = f"WITH {_RUN}, {_OUT.format(top=50)}"


@query(f"""{_RANKS} SELECT count(*) AS queries, round(avg(CASE WHEN gold_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_rate, round(avg(1.0::DOUBLE / gold_rank), 6) AS mrr_found, round(avg(gold_rank), 6) AS mean_rank, round(median(gold_rank)::DOUBLE, 6) AS median_rank FROM r""")
def match_summary(spark, d):
    """Match rate over all queries; reciprocal, mean and median rank over those found."""
    cache, gold, _ = _run(spark, d)
    g = F.col("gold_rank")
    return E.gold_ranks(cache, gold, 50).agg(F.count("*").alias("queries"), E.share(g.isNotNull()).alias("match_rate"), F.round(F.avg(1 / g), 6).alias("mrr_found"), F.round(F.avg(g), 6).alias("mean_rank"), F.round(F.median(g).cast("double"), 6).alias("median_rank"))


@query("""WITH x AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_partkey AS doc_id, CASE WHEN l_partkey % 17 = 0 THEN -1 WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 7 END AS choice FROM lineitem),
p AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY md5('42|' || query_id || '|' || doc_id), rank) - 1) // 5 AS g FROM x WHERE rank <= 10),
w AS (SELECT query_id, g, min(choice) < 0 AS bad, max(choice) > 0 AS has, arg_max({'r': rank, 'c': choice}, choice * 1000 - rank) AS won, count(*) > 1 AS calls FROM p GROUP BY 1, 2)
SELECT query_id, CASE WHEN bool_or(bad) THEN -1 WHEN count(*) FILTER (has) = 0 THEN 0 ELSE arg_max(won.r, won.c * 1000 - won.r) FILTER (has) END::INT AS chosen, (count(*) FILTER (calls) + CASE WHEN count(*) FILTER (has) = 2 AND NOT bool_or(bad) THEN 1 ELSE 0 END)::BIGINT AS calls FROM w GROUP BY 1""")
def tournament_two_groups(spark, d):
    """Ten shuffled candidates in two groups with a conditional final; failures and calls counted."""
    cache, _, _ = _run(spark, d)
    choice = F.when(F.col("doc_id") % 17 == 0, -1).when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 7)
    return E.two_group_tournament(cache.withColumn("choice", choice))


@query(f"WITH {_RUN} SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY md5('7|' || query_id || '|' || rank), rank) AS place FROM c")
def candidate_shuffle(spark, d):
    """A seeded order of every query's candidates."""
    w = Window.partitionBy("query_id").orderBy(E.seeded_order(7, F.col("query_id"), F.col("rank")), "rank")
    return _run(spark, d)[0].select("query_id", "rank", F.row_number().over(w).alias("place"))


@query(f"WITH {_RUN} SELECT query_id, list({{'rank': rank, 'doc_id': doc_id, 'score': score}} ORDER BY rank)[1].doc_id AS first_doc, count(*) AS n, string_agg(doc_id, ',' ORDER BY rank) AS docs FROM c WHERE rank <= 4 GROUP BY 1")
def nested_cache(spark, d):
    """A query's first candidates nested in one row, from a cache that was written and read back."""
    folder = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    write_parquet_checked(E.nested_cache(_run(spark, d)[0], 4), folder)
    n = spark.read.parquet(folder)
    c = F.col("candidates")
    return n.select("query_id", F.element_at(c, 1)["doc_id"].alias("first_doc"), F.size(c).cast("long").alias("n"), F.array_join(F.transform(c, lambda x: x["doc_id"].cast("string")), ",").alias("docs"))


@query(f"WITH {_RUN} SELECT c.query_id, c.rank, c.doc_id, g.doc_id IS NOT NULL AS is_gold, coalesce(p_name, '') AS description FROM c LEFT JOIN g USING (query_id, doc_id) LEFT JOIN part ON p_partkey = c.doc_id WHERE c.query_id % 50 = 1")
def candidate_listing(spark, d):
    """The candidates of chosen queries with the gold one marked and described."""
    cache, gold, _ = _run(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    out = cache.where("query_id % 50 = 1").join(gold.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").join(p, "doc_id", "left")
    return out.select("query_id", "rank", "doc_id", F.coalesce("hit", F.lit(False)).alias("is_gold"), F.coalesce("p_name", F.lit("")).alias("description"))


@query("SELECT lang, count(DISTINCT source) AS sources, first(source ORDER BY n DESC, source) AS top_source, max(n) AS top_n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def distinct_and_mode(spark, d):
    """Distinct sources of a language and the most frequent one."""
    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.min(F.struct((-F.col("n")).alias("n"), "source"))["source"].alias("top_source"), F.max("n").alias("top_n"))


_SPLIT = "CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"


@query(f"SELECT {_SPLIT} AS split, count(*) AS total, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg, round(100.0::DOUBLE * count(*) FILTER (toxic = 1) / count(*), 6) AS pos_pct FROM labels GROUP BY 1")
def split_totals(spark, d):
    x = table(spark, d, "labels").groupBy(F.expr(_SPLIT).alias("split"))
    return x.agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"), F.round(100 * F.count_if(F.col("toxic") == 1) / F.count("*"), 6).alias("pos_pct"))


_MARK = "CASE o_orderkey % 6 WHEN 0 THEN 'TP' WHEN 1 THEN 'tp*' WHEN 2 THEN 'Fp*' WHEN 3 THEN 'fn' WHEN 4 THEN 'vn*' ELSE ' tn ' END"


@query(f"SELECT count(*) FILTER (m = 'tp') AS tp, count(*) FILTER (m = 'fp') AS fp, count(*) FILTER (m = 'fn') AS fn, count(*) FILTER (m IN ('tn', 'vn')) AS tn FROM (SELECT replace(lower(trim({_MARK})), '*', '') AS m FROM orders)")
def manual_labels(spark, d):
    """Counts of hand-made marks, with or without an asterisk."""
    m = F.regexp_replace(F.lower(F.trim(F.expr(_MARK))), r"\*", "")
    return table(spark, d, "orders").select(m.alias("m")).agg(*[F.count_if(F.col("m").isin(*names)).alias(k) for k, names in {"tp": ["tp"], "fp": ["fp"], "fn": ["fn"], "tn": ["tn", "vn"]}.items()])


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value IS NOT NULL AND user_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS complete, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def extraction_stats(spark, d):
    """Share of complete rows, and the sum, mean, median and range of the seconds taken."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), E.share(v.isNotNull() & F.col("user_id").isNotNull()).alias("complete"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))


_MODEL = "(SELECT source AS model, lang AS kind, round(avg(toxic), 6) AS f1 FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)"


def _models(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), F.col("lang").alias("kind")), "doc_id")
    return x.groupBy("model", "kind").agg(F.round(F.avg("toxic"), 6).alias("f1"))


@query(f"SELECT row_number() OVER (ORDER BY f1 DESC, model, kind) AS place, model, kind, f1 FROM {_MODEL}")
def model_ranking(spark, d):
    """Models by their measure, with the place."""
    return _models(spark, d).select(F.row_number().over(Window.orderBy(F.desc("f1"), "model", "kind")).alias("place"), "model", "kind", "f1")


@query(f"SELECT kind, max(f1) AS best, first(model ORDER BY f1 DESC, model) AS best_model, min(f1) AS worst, first(model ORDER BY f1, model) AS worst_model, round(avg(f1), 6) AS mean FROM {_MODEL} GROUP BY 1")
def best_worst_mean(spark, d):
    """The best, worst and mean measure of each kind of model."""
    m = _models(spark, d)
    ends = m.groupBy("kind").agg(F.max("f1").alias("best"), F.min("f1").alias("worst"), F.round(F.avg("f1"), 6).alias("mean"))
    at = lambda end, name: m.join(F.broadcast(ends.select("kind", F.col(end).alias("f1"))), ["kind", "f1"]).groupBy("kind").agg(F.min("model").alias(name))
    return ends.join(at("best", "best_model"), "kind").join(at("worst", "worst_model"), "kind").select("kind", "best", "best_model", "worst", "worst_model", "mean")


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)")
def removal_union(spark, d):
    """Ids that either rule removes."""
    return table(spark, d, "documents").where("n_chars < 200").select("doc_id").union(table(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5('5|' || doc_id), doc_id) - 1) % 5 AS subset FROM labels")
def disjoint_subsets(spark, d):
    """Five disjoint subsets with equal shares of each label."""
    placed = split.ranked(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", E.seeded_order(5, F.col("doc_id")))
    return placed.select("doc_id", "toxic", ((F.col("__r") - 1) % 5).alias("subset"))


@query("SELECT round(avg(CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE ELSE 0 END), 6) AS same, avg(CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE ELSE 0 END) > 0.3 AS warned FROM (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) ELSE o_orderstatus END AS b FROM orders)")
def gold_identity(spark, d):
    """How often a query's text is its gold text, and whether that is suspicious."""
    same = F.lower("o_orderpriority") == F.lower(F.when(F.col("o_orderkey") % 4 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderstatus")))
    return table(spark, d, "orders").agg(E.share(same).alias("same"), (F.avg(same.cast("double")) > 0.3).alias("warned"))


@query("SELECT p_partkey, coalesce(string_split(p_name, ' ')[1], '') AS first, CASE WHEN p_size % 5 = 0 THEN '' ELSE string_split(p_name, ' ')[1] END = coalesce(string_split(p_name, ' ')[1], '') AS correct FROM part")
def first_element_correct(spark, d):
    """The first element of a list or '', against gold, case and outer blanks aside."""
    words = F.split("p_name", " ")
    got = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(words, lambda x: F.concat(F.lit(" "), F.upper(x))))
    first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    return table(spark, d, "part").select("p_partkey", first.alias("first"), (F.lower(F.trim(F.coalesce(F.try_element_at(got, F.lit(1)), F.lit("")))) == F.lower(first)).alias("correct"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 100 AND n <= 250")
def rows_slice(spark, d):
    """Rows from one place to before another in key order (-1: to the end)."""
    return crawl.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "n").where("n > 100 AND n <= 250").select("o_orderkey")


@query("SELECT c_custkey, c_name, '' AS portal, c_mktsegment AS label, c_acctbal AS balance FROM customer")
def columns_backfilled(spark, d):
    """A fixed list of columns: renamed, dropped, and '' where a column is missing."""
    c = table(spark, d, "customer").drop("c_nationkey").withColumnsRenamed({"c_mktsegment": "label", "c_acctbal": "balance"})
    return c.select(*[F.col(x) if x in c.columns else F.lit("").alias(x) for x in ("c_custkey", "c_name", "portal", "label", "balance")])


@query("SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 5000)")
def flag_and_membership(spark, d):
    """Equality on flags, members of one set, none of another."""
    docs = table(spark, d, "documents")
    return table(spark, d, "labels").where("toxic = 1 AND quality = 1").join(docs.where("lang = 'en'"), "doc_id", "left_semi").join(docs.where("n_chars > 5000"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 50 THEN '' ELSE md5(text) END AS result FROM documents")
def length_guard(spark, d):
    """Short texts give an empty result in place of an answer."""
    return table(spark, d, "documents").select("doc_id", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 50, "").otherwise(F.md5("text")).alias("result"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id % 2 = 0)")
def anchors_masked(spark, d):
    """Rows without the anchors of a leak check."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.join(e.where("label = 3 AND vec_id % 2 = 0").select("vec_id"), "vec_id", "left_anti").select("vec_id")


_GATED = "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' [] ' WHEN 2 THEN '0' WHEN 3 THEN '-' WHEN 4 THEN 'Dispensa, Pregão' ELSE c_mktsegment END"


@query(f"SELECT c_custkey, CASE WHEN trim({_GATED}) IN ('', '[]', '0', '-') THEN NULL ELSE {_GATED} END AS cleaned, CASE WHEN c_custkey % 3 IN (0, 1) THEN {_GATED} END AS gated FROM customer")
def gold_gate(spark, d):
    """Null literals out, and gold only where it is marked as present."""
    v, p = F.expr(_GATED), F.expr("CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN ' 1.0' ELSE '0' END")
    return table(spark, d, "customer").select("c_custkey", T.null_literal_cleaner(v).alias("cleaned"), T.presence_gate(p, v).alias("gated"))


_LIST = "(SELECT o_custkey % 7 AS portal, o_orderkey // 400 AS page, CAST(o_orderdate AS DATE) AS day, o_orderkey % 9 AS n_links, o_orderkey FROM orders)"


def _listing(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("portal"), F.expr("o_orderkey div 400").alias("page"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 9).alias("n_links"), "o_orderkey")


@query(f"SELECT portal, max(page) AS max_page FROM {_LIST} WHERE n_links > 0 GROUP BY 1")
def max_page(spark, d):
    """The last listing page of each portal that has links."""
    return E.last_page(_listing(spark, d))


@query(f"SELECT portal, page FROM {_LIST} GROUP BY 1, 2 HAVING min(day) <= DATE '1996-06-15' AND max(day) >= DATE '1996-06-15'")
def pages_of_date(spark, d):
    """Listing pages whose dates span a target date."""
    return E.pages_of_date(_listing(spark, d), "1996-06-15")


_VISIT = "(SELECT s_suppkey AS portal, (s_suppkey % 4)::INT AS max_page4, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE (s_suppkey % 30)::INT + 2 END AS max_page, s_suppkey % 3 = 0 AS skip, (s_nationkey)::INT AS days FROM supplier)"


@query(f"SELECT portal, unnest(CASE WHEN max_page <= 1 THEN [1] WHEN days <= 7 OR skip THEN range(1, least(max_page, 10)::INT + 1) ELSE range(1, max_page + 1) END)::INT AS page FROM {_VISIT}")
def visit_policy(spark, d):
    """Pages to read of each portal: one, the first ten, or all."""
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("portal"), F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise((F.col("s_suppkey") % 30).cast("int") + 2).alias("max_page"), F.lit(1).alias("min_page"), (F.col("s_suppkey") % 3 == 0).alias("skip_binary_search"), F.col("s_nationkey").alias("days_ago"))
    return crawl.pages_to_visit(c)


@query("SELECT url, min(page) AS page FROM (SELECT regexp_extract(url, '^[^?#]*') AS url, (page_id // 20)::INT AS page FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def first_article(spark, d):
    """Articles of the target date, the first listing page's row of each URL."""
    a = table(spark, d, "pages").select(F.regexp_extract("url", r"^[^?#]*", 0).alias("url"), F.expr("CAST(page_id div 20 AS INT)").alias("page_number"), F.when(F.col("page_id") % 3 == 0, F.lit("2024-05-02")).otherwise("2024-05-01").cast("date").alias("date_publication"))
    return crawl.first_of_each_url(a, "2024-05-02").select("url", F.col("page_number").alias("page"))


@query("SELECT url, min(page_id) AS page_id, 'news' AS entity_type, any_value(length(regexp_extract(html, '<title>([^<]*)</title>', 1))) FILTER (true) >= 0 AS has_title FROM pages GROUP BY 1")
def portal_collection(spark, d):
    """Every page of a portal, one row a URL, tagged with the kind of record."""
    p = table(spark, d, "pages")
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min(F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("n")).select("url", "page_id", F.lit("news").alias("entity_type"), (F.col("n") >= 0).alias("has_title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'folder' WHEN c_custkey % 5 = 1 THEN 'collect_all' WHEN c_custkey % 5 = 2 THEN 'legacy' ELSE 'dated' END AS route FROM customer")
def message_routes(spark, d):
    """The way of each trigger message."""
    k = F.col("c_custkey") % 5
    m = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "in/").when(k == 1, "").alias("folder"), (k <= 1).alias("collect_all"), F.when(k < 3, True).alias("legacy"))
    return E.routed(m).select("c_custkey", "route")


@query("SELECT event_id, CASE WHEN event_id > 0 THEN round(event_id / (event_id * 2 + 3), 6) END AS per_second, CASE WHEN event_id > 0 THEN round((20000 - event_id) / (event_id / (event_id * 2 + 3)), 6) END AS seconds_left FROM events")
def progress_eta(spark, d):
    """Throughput and time left."""
    e = table(spark, d, "events").select("event_id", F.lit(20000).alias("total"), (F.col("event_id") * 2 + 3).alias("elapsed"))
    return E.progress(e, "event_id", "total", "elapsed").select("event_id", "per_second", "seconds_left")


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-20') BETWEEN 0 AND 7 AS recent FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-20 00:00:00'")
def recent_orders(spark, d):
    """Whether a date is at most seven days old."""
    o = table(spark, d, "orders").where("o_orderdate <= TIMESTAMP '1997-01-20 00:00:00'")
    return o.select("o_orderkey", D.is_recent(F.col("o_orderdate"), F.lit("1997-01-20").cast("date")).alias("recent"))


@query("SELECT s_suppkey, CASE WHEN a >= 0.7 AND b >= 0.7 THEN 'LOW' WHEN a >= 0.5 OR b >= 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS bias, 'https://x.example/p/' || s_suppkey || '/' AS url FROM (SELECT s_suppkey, (s_suppkey % 11) / 10 AS a, (s_suppkey % 7) / 6 AS b FROM supplier)")
def bias_and_page_url(spark, d):
    """The bias rule over two shares, and a page's address from its template."""
    return table(spark, d, "supplier").select("s_suppkey", T.bias_level((F.col("s_suppkey") % 11) / 10, (F.col("s_suppkey") % 7) / 6).alias("bias"), T.page_url(F.lit("https://x.example/p/{}/"), F.col("s_suppkey")).alias("url"))


@query("SELECT l_orderkey, string_agg(n || '. ' || p_name, chr(10) || chr(10) ORDER BY n) AS listed FROM (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name) AS n FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1")
def numbered_candidates(spark, d):
    """Candidates as a numbered text."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda s: s["p_name"])
    return x.groupBy("l_orderkey").agg(items.alias("items")).select("l_orderkey", T.numbered_list(F.col("items")).alias("listed"))


_MODAL = "CASE o_orderkey % 7 WHEN 0 THEN 'Pregão Eletrônico nº ' || o_orderkey WHEN 1 THEN 'PREGAO PRESENCIAL' WHEN 2 THEN 'tomada de preços' WHEN 3 THEN 'Dispensa e Inexigibilidade' WHEN 4 THEN 'Concorrência pública' WHEN 5 THEN 'RDC' ELSE 'contrato' END"


@query(f"""SELECT o_orderkey, CASE WHEN m LIKE '%pregao eletronico%' THEN 'Pregão Eletrônico' WHEN m LIKE '%pregao presencial%' THEN 'Pregão Presencial' WHEN m LIKE '%concorrencia%' THEN 'Concorrência' WHEN m LIKE '%tomada de preco%' THEN 'Tomada de Preços'
WHEN m LIKE '%dispensa%' THEN 'Dispensa de Licitação' WHEN m LIKE '%inexigibilidade%' THEN 'Inexigibilidade' WHEN m LIKE '%rdc%' THEN 'Regime Diferenciado' END AS modality FROM (SELECT o_orderkey, strip_accents(lower({_MODAL})) AS m FROM orders)""")
def modality_norm(spark, d):
    """The modality that a text names, from the constant relation of modalities."""
    return table(spark, d, "orders").select("o_orderkey", E.modality(T.fold_accents(F.lower(F.expr(_MODAL)))).alias("modality"))


@query(f"""SELECT v.id, v.name, count(m.name) AS orders FROM (VALUES (0, 'Pregão Eletrônico'), (1, 'Pregão Presencial'), (2, 'Concorrência'), (3, 'Tomada de Preços'), (4, 'Convite'), (5, 'Leilão'), (6, 'Concurso'), (7, 'Dispensa de Licitação'), (8, 'Inexigibilidade'), (9, 'Chamamento Público'), (10, 'Credenciamento'), (11, 'Regime Diferenciado')) AS v(id, name) LEFT JOIN (SELECT CASE WHEN m LIKE '%pregao eletronico%' THEN 'Pregão Eletrônico' WHEN m LIKE '%pregao presencial%' THEN 'Pregão Presencial' WHEN m LIKE '%concorrencia%' THEN 'Concorrência' WHEN m LIKE '%tomada de preco%' THEN 'Tomada de Preços'
WHEN m LIKE '%dispensa%' THEN 'Dispensa de Licitação' WHEN m LIKE '%inexigibilidade%' THEN 'Inexigibilidade' WHEN m LIKE '%rdc%' THEN 'Regime Diferenciado' END AS name FROM (SELECT strip_accents(lower({_MODAL})) AS m FROM orders)) m ON m.name = v.name GROUP BY ALL""")
def modality_table(spark, d):
    """The constant relation of modalities, with the orders whose text names each."""
    names = spark.createDataFrame(list(enumerate(E.MODALITIES)), "id int, name string")
    named = table(spark, d, "orders").select(E.modality(T.fold_accents(F.lower(F.expr(_MODAL)))).alias("name")).groupBy("name").agg(F.count("*").alias("orders"))
    return names.join(named, "name", "left").select("id", "name", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


@query("SELECT c_custkey, len(list_distinct(s)) AS n, array_to_string(list_sort(list_distinct(s)), ',') AS members, array_to_string(list_filter([c_mktsegment, '[ ]', '[]'], lambda x: regexp_replace(x, '[\\[\\] ]', '', 'g') <> ''), ',') AS kept FROM (SELECT c_custkey, c_mktsegment, list_filter(list_transform(string_split(c_mktsegment || ', a,, A ,' || c_custkey, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS s FROM customer)")
def comma_sets(spark, d):
    """Comma lists as sets, and lists without bracket residue."""
    s = T.comma_set(F.concat(F.col("c_mktsegment"), F.lit(", a,, A ,"), F.col("c_custkey").cast("string")))
    kept = T.drop_bracket_items(F.array(F.col("c_mktsegment"), F.lit("[ ]"), F.lit("[]")))
    return table(spark, d, "customer").select("c_custkey", F.size(s).cast("long").alias("n"), F.array_join(F.array_sort(s), ",").alias("members"), F.array_join(kept, ",").alias("kept"))


@query("""SELECT s_suppkey, CASE WHEN g IS NULL THEN CASE WHEN len(p) = 0 THEN 'TN' ELSE 'FP' END WHEN list_sort(g) = list_sort(p) THEN 'TP' WHEN len(p) = 0 THEN 'FN' ELSE 'FP' END AS strict, CASE WHEN g IS NULL THEN CASE WHEN len(p) = 0 THEN 'TN' ELSE 'FP' END WHEN list_has_all(p, g) THEN 'TP' ELSE 'FN' END AS contains
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['a', 'b'] ELSE ['a'] END AS g, CASE s_suppkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['b', 'a'] WHEN 2 THEN ['a'] WHEN 3 THEN ['c'] ELSE ['a', 'c'] END::VARCHAR[] AS p FROM supplier)""")
def set_scores(spark, d):
    """Strict and containing verdicts of multi-valued attributes."""
    g = F.expr("CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A, b' ELSE 'a' END")
    p = F.expr("CASE s_suppkey % 5 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('b ', 'a') WHEN 2 THEN array('A') WHEN 3 THEN array('c') ELSE array('a', 'c') END")
    return table(spark, d, "supplier").select("s_suppkey", T.attribute_class(g, p, True).alias("strict"), T.attribute_class(g, p, False).alias("contains"))


_REPORT = """p AS (SELECT x.class, (SELECT count(*) FROM t WHERE y = x.class) AS support, (SELECT count(*) FROM t WHERE p = x.class) AS said, (SELECT count(*) FROM t WHERE y = x.class AND p = x.class) AS tp FROM (SELECT y AS class FROM t UNION SELECT p FROM t) x),
q AS (SELECT class, CASE WHEN said > 0 THEN tp / said ELSE 0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END::DOUBLE AS recall, support FROM p),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q),
rep AS (SELECT class, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)"""
_MADE = "CAST(CASE WHEN doc_id % 4 = 0 THEN quality ELSE toxic END AS VARCHAR)"


def _reported(spark, d, where):
    x = table(spark, d, "labels").where(where).select(F.col("toxic").alias("y"), F.when(F.col("doc_id") % 4 == 0, F.col("quality")).otherwise(F.col("toxic")).alias("p"))
    return E.classification_report(x, "y", "p")


@query(f"WITH t AS (SELECT CAST(toxic AS VARCHAR) AS y, {_MADE} AS p FROM labels), {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rep")
def classification_report(spark, d):
    """Precision, recall, F1 and support by class, and their means."""
    return _reported(spark, d, "true")


def _gap_side(name, where):
    inner = _REPORT.replace("FROM t", f"FROM t_{name}").replace(" p AS (", "")
    for x in ("p", "q", "f", "rep"):
        inner = inner.replace(f"{x} AS (SELECT", f"{x}_{name} AS (SELECT").replace(f"FROM {x} ", f"FROM {x}_{name} ").replace(f"FROM {x})", f"FROM {x}_{name})")
    return f"t_{name} AS (SELECT CAST(toxic AS VARCHAR) AS y, {_MADE} AS p FROM labels WHERE {where}), {inner}"


@query(f"""WITH {_gap_side('dev', 'doc_id % 2 = 0')}, {_gap_side('test', 'doc_id % 2 = 1')}
SELECT a.class, {", ".join(f"round(a.{c}, 6) AS {c}_dev, round(b.{c}, 6) AS {c}_test, round(round(b.{c}, 6) - round(a.{c}, 6), 6) AS {c}_gap" for c in ("precision", "recall", "f1"))} FROM rep_dev a FULL JOIN rep_test b USING (class)""")
def gap_table(spark, d):
    """Two reports side by side with their differences."""
    return E.gap_table(_reported(spark, d, "doc_id % 2 = 0"), _reported(spark, d, "doc_id % 2 = 1"))


@query("SELECT count(*) AS n, bool_and(a IS NOT DISTINCT FROM b) AS consistent, count(*) FILTER (a IS DISTINCT FROM b) AS differing FROM (SELECT doc_id, toxic AS a FROM labels) x FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 1 - toxic ELSE toxic END AS b FROM labels WHERE doc_id % 89 <> 3) y USING (doc_id)")
def label_consistency(spark, d):
    """Whether two label files agree row by row."""
    a = table(spark, d, "labels")
    b = a.where("doc_id % 89 <> 3").select("doc_id", F.when(F.col("doc_id") % 97 == 5, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return a.select("doc_id", F.col("toxic").alias("a")).join(b, "doc_id", "full").agg(F.count("*").alias("n"), F.bool_and(same).alias("consistent"), F.count_if(~same).alias("differing"))


@query("SELECT toxic, count(*) AS n, min(doc_id) AS least FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('3|' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY toxic) AS total FROM labels) WHERE n <= total // 2 GROUP BY 1")
def half_of_train(spark, d):
    """The half of each label on which the memorisation check fits."""
    half = split.ranked(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", E.seeded_order(3, F.col("doc_id"))).where("__r <= __n div 2")
    return half.groupBy("toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("SELECT label, i, round(avg(x::DOUBLE), 5) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 4 <> 0) GROUP BY 1, 2")
def mean_pooling(spark, d):
    """Masked mean of vectors by key."""
    pooled = E.mean_pooled(table(spark, d, "embeddings"), "label", "embedding", F.col("vec_id") % 4 != 0)
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"SELECT a.vec_id, b.vec_id AS other, {_DOT} / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))) >= 0.83 AS matched FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_match(spark, d):
    """Whether two texts' vectors are at a cosine of 0.83 or more."""
    e = table(spark, d, "embeddings").select("vec_id", T.l2_normalised(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return e.join(b, "vec_id").select("vec_id", (F.col("vec_id") + 1).alias("other"), (T.dot(F.col("v"), F.col("u")) >= 0.83).alias("matched"))


@query("SELECT s_suppkey, coalesce(nullif(trim(made), ''), original) AS text FROM (SELECT s_suppkey, s_name AS original, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'made ' || s_name END AS made FROM supplier)")
def generated_or_original(spark, d):
    """A generated text, or the original where it is missing or blank."""
    made = F.expr("CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat('made ', s_name) END")
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.nullif(F.trim(made), F.lit("")), F.col("s_name")).alias("text"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS objeto FROM events")
def single_field(spark, d):
    """One field of a JSON answer, '' where it is absent."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("objeto"))


@query("SELECT source, printf('%.4f', avg(n_chars)) AS mean, printf('%.4f', max(n_chars)::DOUBLE) AS most, CAST(count(*) AS VARCHAR) AS rows FROM documents GROUP BY 1")
def metric_csv(spark, d):
    """Metrics in their fixed format of four places, as the CSV on disk has them."""
    m = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.max("n_chars").cast("double").alias("most"), F.count("*").alias("rows"))
    return write_metrics(m, f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}")


@query("""SELECT p_partkey, concat_ws('|', coalesce(p_name, ''), coalesce(p_brand, ''), coalesce(p_type, ''), coalesce(CAST(p_size AS VARCHAR), '')) AS row, header FROM part,
(SELECT string_agg(column_name, ',' ORDER BY CASE WHEN column_name LIKE '%_type' THEN 2 WHEN column_name LIKE '%_size' THEN 1 ELSE 0 END, i) AS header FROM (SELECT column_name, row_number() OVER () AS i FROM (DESCRIBE part)))""")
def ordered_export(spark, d):
    """An export whose columns are ordered by suffix: its rows as they read back, and the header on disk."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    p = table(spark, d, "part")
    write_ordered(p, path, ["_size", "_type"])
    header = header_of(spark, path)
    kinds = dict(p.dtypes)
    back = read_csv(spark, path, ", ".join(f"`{c}` {kinds[c]}" for c in header))
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("p_name", "p_brand", "p_type", "p_size")])
    return back.select("p_partkey", row.alias("row"), F.lit(",".join(header)).alias("header"))


@query(r"""SELECT page_id, url, regexp_extract(regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', ''), '^.*?://[^/]*/.*?([^/]+)$', 1) AS tail, true AS own_file, count(*) OVER () AS files FROM pages""")
def json_records(spark, d):
    """Pages as single JSON files by the tail of their URL: each in its own file, and together in one table."""
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = table(spark, d, "pages").select("page_id", "url", url_tail(F.col("url")).alias("tail"))
    write_json_records(rows, folder, "tail", "page_id")
    back = read_json_records(spark, folder, "page_id long, url string, tail string")
    each = back.groupBy("file").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).select("page_id", (F.col("n") == 1).alias("own_file"))
    every = spark.read.schema(back.drop("file").schema).json(f"{folder}/all")
    return every.join(each, "page_id").join(F.broadcast(each.agg(F.count("*").alias("files"))), F.lit(True))


@query("SELECT s_suppkey, s_name, s_nationkey, 2 AS writes, 1 AS backups, true AS before_kept FROM supplier")
def replaced_table(spark, d):
    """A table that was replaced: the new rows as read back, and that the backup holds the old ones."""
    path = f"{shared_dir(spark)}/replaced-{uuid.uuid4().hex}/supplier"
    new = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    old = new.where("s_suppkey % 2 = 0")
    backups = [b for b in (replace_checked(old, path), replace_checked(new, path)) if b]
    kept = digest(spark.read.schema(old.schema).parquet(backups[0])) == digest(old)
    return spark.read.schema(new.schema).parquet(path).select("*", F.lit(2).alias("writes"), F.lit(len(backups)).alias("backups"), F.lit(kept).alias("before_kept"))


@query("""WITH l AS (SELECT coalesce(lang, '') AS lang, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY 1), t AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
x AS (SELECT 0 AS part, 0 AS k, unnest(['# Corpus', '', '## Languages', '', 'Documents and their mean length.', '', '| lang | documents | mean_chars |', '| --- | --- | --- |']) AS line
UNION ALL SELECT 1, row_number() OVER (ORDER BY lang), '| ' || lang || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |' FROM l UNION ALL SELECT 2, 0, unnest(['', '## Labels', '', '| toxic | rows |', '| --- | --- |'])
UNION ALL SELECT 3, row_number() OVER (ORDER BY toxic), '| ' || toxic || ' | ' || n || ' |' FROM t UNION ALL SELECT 4, 0, '')
SELECT line, count(*) AS times, max(part) AS part FROM x GROUP BY 1""")
def report_lines(spark, d):
    """A report of the corpus as it stands on disk: its lines, how often each, and the last part that has it."""
    by_lang = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("documents"), F.avg("n_chars").alias("mean_chars")).orderBy("lang")
    by_label = table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("rows")).orderBy("toxic")
    sections = [reports.section("Languages", by_lang, "Documents and their mean length."), reports.section("Labels", by_label)]
    lines = reports.write_report("Corpus", sections, f"{shared_dir(spark)}/report-{uuid.uuid4().hex}", by_lang)
    ends = [8, len(sections[0]) + 1]  # lines of the head, and where the table of languages ends
    part = F.when(F.col("number") < ends[0], 0).when(F.col("number") < ends[1], 1).when(F.col("number") < ends[1] + 5, 2)
    part = part.when(F.col("number") < ends[1] + len(sections[1]), 3).otherwise(4)
    return lines.withColumn("part", part).groupBy("line").agg(F.count("*").alias("times"), F.max("part").alias("part"))
