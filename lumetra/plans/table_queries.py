"""Queries over joins, aggregates, splits and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, metrics, split
from ..sources.tables import table
from .registry import query


def _scored(spark, d):
    """Labels with a deterministic score: hash of the id, raised for positives."""
    h = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") % 1000) / 1000
    return table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"), F.round(h * 0.8 + F.col("toxic") * 0.2, 3).alias("score"))


SCORED = "(SELECT doc_id, toxic AS label, round((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE + toxic * 0.2::DOUBLE, 3) AS score FROM labels)"


@query("SELECT p_partkey, s.s_suppkey, p_brand FROM part JOIN (SELECT s_suppkey, 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_nationkey % 5 + 1 AS VARCHAR) AS b, s_suppkey % 50 + 1 AS size FROM supplier) s ON lower(trim(p_brand)) = lower(trim(s.b)) AND p_size = s.size UNION ALL SELECT NULL, s_suppkey, NULL FROM (SELECT s_suppkey, 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_nationkey % 5 + 1 AS VARCHAR) AS b, s_suppkey % 50 + 1 AS size FROM supplier) s WHERE NOT EXISTS (SELECT 1 FROM part WHERE lower(trim(p_brand)) = lower(trim(s.b)) AND p_size = s.size)")
def block_join(spark, d):
    """Suppliers as queries, parts as base, blocked on two keys; unmatched queries stay."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" BRAND#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 5 + 1).cast("string")).alias("b"), (F.col("s_suppkey") % 50 + 1).alias("size"))
    p = table(spark, d, "part")
    key = lambda c: F.lower(F.trim(c))
    return s.join(p, (key(s["b"]) == key(p["p_brand"])) & (s["size"] == p["p_size"]), "left").select("p_partkey", "s_suppkey", "p_brand")


@query("SELECT c_custkey, coalesce(o.last_status, '') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def enrich_last_wins(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    c = table(spark, d, "customer")
    return c.join(last, c["c_custkey"] == last["o_custkey"], "left").select("c_custkey", F.coalesce("last_status", F.lit("")).alias("last_status"))


@query("SELECT CASE WHEN c IS NULL THEN 'right' WHEN o IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM (SELECT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o GROUP BY 1")
def key_audit(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("c")), table(spark, d, "orders").select(F.col("o_custkey").alias("o")).distinct()
    return c.join(o, F.col("c") == F.col("o"), "full").groupBy(F.when(F.col("c").isNull(), "right").when(F.col("o").isNull(), "left").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


def _halves(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", "source")
    return x.where("doc_id % 5 <> 0"), x.where("doc_id % 5 = 0")


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 <> 0)")
def split_overlap(spark, d):
    train, test = _halves(spark, d)
    return split.shared_keys(test, train, F.col("text")).agg(F.count("*").alias("shared"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 5 <> 0 AND text <> '')")
def anti_split(spark, d):
    train, test = _halves(spark, d)
    return split.without_shared_keys(test, train, F.col("text")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND NOT (source < 'src5' AND substr(text, 1, 200) IN (SELECT substr(text, 1, 200) FROM documents WHERE doc_id % 5 <> 0 AND source >= 'src5'))")
def prefix_anti(spark, d):
    """Flagged test rows go when a train row that is not flagged begins alike."""
    train, test = _halves(spark, d)
    flagged = F.col("source") < "src5"
    checked = split.without_shared_keys(test.where(flagged), train.where(~flagged), F.substring("text", 1, 200))
    return checked.unionByName(test.where(~flagged)).select("doc_id")


@query("SELECT toxic AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM labels GROUP BY 1")
def label_dist(spark, d):
    counts = table(spark, d, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("label", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 2).alias("pct"))


@query("SELECT toxic AS label, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, min(length(text)) AS least, max(length(text)) AS most FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def len_stats(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).join(table(spark, d, "labels"), "doc_id")
    return x.groupBy(F.col("toxic").alias("label")).agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("SELECT source AS portal, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS pos, CAST(count(*) - sum(toxic) AS BIGINT) AS neg, round(100.0::DOUBLE * sum(toxic) / count(*), 1) AS pos_pct FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY n DESC, portal LIMIT 10")
def portal_table(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").groupBy(F.col("source").alias("portal")).agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("pos"))
    return x.select("portal", "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.round(F.lit(100.0) * F.col("pos") / F.col("n"), 1).alias("pos_pct")).orderBy(F.desc("n"), "portal").limit(10)


@query("SELECT count(*) - count(d.doc_id) AS doc_id, count(*) - count(quality) AS quality, count(*) - count(toxic) AS toxic, count(*) - count(text) AS text FROM documents d LEFT JOIN labels USING (doc_id)")
def null_counts(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("doc_id", "quality", "toxic", "text")])


@query("SELECT source, count(*) - count(DISTINCT text) AS dups FROM documents GROUP BY 1")
def dup_within(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.count("*") - F.countDistinct("text")).alias("dups"))


@query("SELECT p_name AS text, list_aggregate(list_sort(list(CAST(p_partkey AS VARCHAR))), 'string_agg', ',') AS ids, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    return table(spark, d, "part").groupBy(F.trim("p_name").alias("text")).agg(F.array_join(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))), ",").alias("ids"), F.count("*").alias("n")).where("n > 1")


@query("SELECT size, count(*) AS groups FROM (SELECT text, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def dup_hist(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("size")).where("size > 1").groupBy("size").agg(F.count("*").alias("groups"))


@query(rf"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, trim(regexp_replace(regexp_replace(trim(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')), '[.!?;:]+$', ''), '[\s\x{{00A0}}]+', ' ', 'g')) AS norm FROM documents)
SELECT md5(arg_min(text, id)) AS representative, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM x GROUP BY norm HAVING count(*) > 1""")
def identical_groups(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", T.identity_norm(F.col("text")).alias("norm"))
    return x.groupBy("norm").agg(F.md5(F.min_by("text", "id")).alias("representative"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n")).where("n > 1").select("representative", "ids", "n")


@query(rf"""WITH x AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(trim(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')), '[.!?;:]+$', ''), '[\s\x{{00A0}}]+', ' ', 'g')) AS norm FROM documents)
SELECT a.doc_id AS chosen, b.doc_id AS gold, CASE WHEN a.text = b.text AND a.norm = b.norm THEN 'ambos' WHEN a.text = b.text THEN 'duplicatas' WHEN a.norm = b.norm THEN 'identical_objects' ELSE 'none' END AS kind FROM x a JOIN x b ON b.doc_id = a.doc_id % 97""")
def equivalence_check(spark, d):
    """Each document against a gold one: same text group, same normalised group, both or none."""
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("dup"), F.md5(T.identity_norm(F.col("text"))).alias("ident"))
    g = x.select(F.col("doc_id").alias("gold"), F.col("dup").alias("gold_dup"), F.col("ident").alias("gold_ident"))
    p = x.withColumn("gold", F.col("doc_id") % 97).join(g, "gold")
    same_d, same_i = F.col("dup") == F.col("gold_dup"), F.col("ident") == F.col("gold_ident")
    return p.select(F.col("doc_id").alias("chosen"), "gold", F.when(same_d & same_i, "ambos").when(same_d, "duplicatas").when(same_i, "identical_objects").otherwise("none").alias("kind"))


_PRF = """round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_COUNTS = "count(*) FILTER (label = 1 AND score >= 0.6) AS tp, count(*) FILTER (label = 0 AND score >= 0.6) AS fp, count(*) FILTER (label = 1 AND score < 0.6) AS fn, count(*) FILTER (label = 0 AND score < 0.6) AS tn"


@query(f"SELECT *, {_PRF} FROM (SELECT {_COUNTS} FROM {SCORED})")
def confusion_prf(spark, d):
    return metrics.confusion(_scored(spark, d), F.col("label"), (F.col("score") >= 0.6).cast("int"))


@query(f"SELECT round(avg(CASE WHEN (score >= t) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS macro_accuracy FROM {SCORED}, (SELECT unnest([0.2::DOUBLE, 0.4, 0.6, 0.8]) AS t)")
def macro_accuracy(spark, d):
    """Mean accuracy over four thresholds, as over four attributes."""
    x = _scored(spark, d)
    each = x.agg(*[F.avg(((F.col("score") >= t) == (F.col("label") == 1)).cast("double")).alias(f"t{i}") for i, t in enumerate((0.2, 0.4, 0.6, 0.8))])
    return each.select(F.round((F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")) / 4, 6).alias("macro_accuracy"))


@query(f"SELECT *, {_PRF} FROM (SELECT source, {_COUNTS} FROM {SCORED} JOIN documents USING (doc_id) GROUP BY source HAVING sum(label) > 0)")
def metrics_by_group(spark, d):
    """Groups without positives are skipped."""
    x = _scored(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.confusion(x, F.col("label"), (F.col("score") >= 0.6).cast("int"), ["source"]).where("tp + fn > 0")


@query(f"WITH s AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {SCORED} GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS above, sum(pos) OVER (ORDER BY score DESC) AS tp FROM s) SELECT round(sum(pos::DOUBLE * tp / above) / sum(pos), 6) AS average_precision FROM c")
def avg_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), "label", "score")


@query(f"SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS roc_auc FROM (SELECT * FROM {SCORED} WHERE label = 1) a, (SELECT * FROM {SCORED} WHERE label = 0) b")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), "label", "score")


@query(f"WITH s AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {SCORED} GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS above, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS p FROM s) SELECT score AS threshold, round(2.0::DOUBLE * tp / (above + p), 6) AS f1 FROM c ORDER BY round(2.0::DOUBLE * tp / (above + p), 9) DESC, score DESC LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(_scored(spark, d), "label", "score")


def _clusters(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("embedding")[0] > 0, F.col("label") % 4).otherwise(F.col("label") % 3 + 4).alias("cluster"))


CLUSTERS = "(SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN label % 4 ELSE label % 3 + 4 END AS cluster FROM embeddings)"


@query(f"SELECT round(sum(top)::DOUBLE / sum(n), 6) AS purity FROM (SELECT cluster, max(n) AS top, sum(n) AS n FROM (SELECT cluster, label, count(*) AS n FROM {CLUSTERS} GROUP BY 1, 2) GROUP BY 1)")
def cluster_purity(spark, d):
    return metrics.purity(_clusters(spark, d), "cluster", "label")


@query(f"""WITH t AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM {CLUSTERS} GROUP BY 1, 2), a AS (SELECT sum(n) AS n FROM t),
c AS (SELECT sum(n) AS m FROM t GROUP BY cluster), l AS (SELECT sum(n) AS m FROM t GROUP BY label),
h AS (SELECT (SELECT -sum(m / a.n * ln(m / a.n)) FROM c, a) AS hc, (SELECT -sum(m / a.n * ln(m / a.n)) FROM l, a) AS hl, (SELECT -sum(t.n / a.n * ln(t.n / a.n)) FROM t, a) AS hj,
 (SELECT sum(m * (m - 1) / 2) FROM c) AS pc, (SELECT sum(m * (m - 1) / 2) FROM l) AS pl, (SELECT sum(n * (n - 1) / 2) FROM t) AS pj, (SELECT n * (n - 1) / 2 FROM a) AS pa),
k AS (SELECT (hc + hl - hj) / hl AS hom, (hc + hl - hj) / hc AS com, (pj - pc * pl / pa) / ((pc + pl) / 2 - pc * pl / pa) AS ari FROM h)
SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round(ari, 6) AS adjusted_rand FROM k""")
def vmeasure_ari(spark, d):
    return metrics.agreement(_clusters(spark, d), "cluster", "label")


@query(f"SELECT cluster, {', '.join(f'count(*) FILTER (label = {i}) AS l{i}' for i in range(10))} FROM {CLUSTERS} GROUP BY 1")
def crosstab(spark, d):
    wide = _clusters(spark, d).groupBy("cluster").agg(*[F.count_if(F.col("label") == i).alias(f"l{i}") for i in range(10)])
    return wide


@query(f"SELECT t AS threshold, label, count(*) FILTER (score >= t) AS n FROM {SCORED}, (SELECT unnest([0.9999::DOUBLE, 0.999, 0.99, 0.98, 0.95, 0.5]) AS t) GROUP BY 1, 2")
def thresh_ladder(spark, d):
    x = _scored(spark, d)
    steps = (0.9999, 0.999, 0.99, 0.98, 0.95, 0.5)
    flags = x.groupBy("label").agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(steps)])
    return flags.select("label", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(steps)])).alias("x")).select(F.col("x.threshold").alias("threshold"), "label", F.col("x.n").alias("n"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_dedup(spark, d):
    return dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id")


@query("""WITH r AS (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, label, CASE WHEN r <= floor(n * 0.64::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return split.stratified_split(rows, "label", "doc_id", [("train", 0.64), ("dev", 0.16), ("test", 0.2)])


@query("SELECT doc_id, toxic AS label, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, d):
    return split.stratified_folds(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "label", "doc_id")


@query("SELECT toxic AS label, count(*) AS n, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)) AS weight FROM labels GROUP BY 1")
def class_weights(spark, d):
    return split.class_weights(table(spark, d, "labels").select(F.col("toxic").alias("label")), "label")


@query("SELECT label, coalesce('Rank ' || CAST(CASE WHEN score > 0.3 THEN CAST(floor(score * 10) AS INTEGER) END AS VARCHAR), 'Não encontrado') AS rank, count(*) AS n FROM " + SCORED + " GROUP BY 1, 2")
def rank_hist_errors(spark, d):
    r = F.when(F.col("score") > 0.3, F.floor(F.col("score") * 10).cast("int"))
    return _scored(spark, d).groupBy("label", F.coalesce(F.concat(F.lit("Rank "), r.cast("string")), F.lit("Não encontrado")).alias("rank")).agg(F.count("*").alias("n"))


_PAGES = "(SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id // 20 AS page FROM events)"


@query(f"SELECT page, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, bool_or(day = DATE '2024-01-10') AS has_target FROM {_PAGES} GROUP BY 1")
def page_date_range(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 20).alias("page"))
    return e.groupBy("page").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.bool_or(F.col("day") == F.lit("2024-01-10").cast("date")).alias("has_target"))


@query(f"WITH h AS (SELECT page, bool_or(day = DATE '2024-01-10') AS hit FROM {_PAGES} GROUP BY 1), r AS (SELECT page, page - row_number() OVER (ORDER BY page) AS run FROM h WHERE hit) SELECT min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM r GROUP BY run")
def page_runs(spark, d):
    """Contiguous runs of pages that hold the target day."""
    from ..operators import crawl

    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 20).alias("page"))
    hits = e.where(F.col("day") == F.lit("2024-01-10").cast("date")).select("page").distinct()
    return crawl.contiguous_runs(hits, "page")


@query("SELECT vec_id, lag(label) OVER (ORDER BY vec_id) AS label FROM embeddings")
def shift_repair(spark, d):
    """A column moved down by one row, by an equi-join on the number of the row before."""
    from ..operators import crawl

    return crawl.shifted(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("SELECT a.r AS pair, a.item_id, b.conv_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) a JOIN (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r FROM (SELECT DISTINCT conv_id FROM conversations)) b USING (r)")
def positional_pairs(spark, d):
    """News i with process i, as many as the shorter side has."""
    from ..operators import crawl

    a, b = table(spark, d, "benchmark").select("item_id"), table(spark, d, "conversations").select("conv_id").distinct()
    return crawl.numbered(a, "item_id", "pair").join(crawl.numbered(b, "conv_id", "pair"), "pair")
