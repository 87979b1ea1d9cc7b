"""Queries over indexes, chunks, saved models, resumed jobs, retries, streams, page search and leak checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode
from ..operators import chunks, leakage, metrics, page_search, split, text_model, vector_index
from ..sources import models, resumable
from ..sources.shared import materialised, shared_dir
from ..sources.tables import table, table_stream
from ..streaming import jobs, retry
from .linkage_queries import _COS, _halves
from .registry import query

W = T.WORD


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# a stored index of vectors


@query(f"""SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS INTEGER) AS rank, cos FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)
QUALIFY rank <= 10""")
def index_topk(spark, d):
    """Each test vector's ten nearest train vectors, from an index on disk."""
    queries, base = _halves(spark, d)
    folder = _folder(spark, "index")
    vector_index.build(base, folder, cells=16)
    return vector_index.search(queries, folder, 10)


# chunks of documents

_CHUNKS = r"""c AS (SELECT doc_id, start, substr(text, start + 1, 600) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 500)) AS start FROM documents WHERE regexp_matches(text, '\S')))"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(chunk) AS INTEGER) AS \"end\", length(chunk)::INTEGER AS n_chars, md5(chunk) AS md5 FROM c")
def fixed_chunks(spark, d):
    """Every document in chunks of 600 characters that overlap by 100."""
    c = chunks.chunked(table(spark, d, "documents"), "doc_id", "text", 600, 100, fixed=True)
    return c.select("doc_id", "start", "end", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("md5"))


@query(rf"""WITH {_CHUNKS}, p AS (SELECT doc_id, start, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, start, unnest(regexp_extract_all(lower(chunk), '{W}')) AS term FROM c) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS chunks FROM c GROUP BY 1), f AS (SELECT doc_id, term, count(*) AS df FROM p GROUP BY ALL),
h AS (SELECT doc_id, start, term, tf * (ln((1.0::DOUBLE + chunks) / (1.0::DOUBLE + df)) + 1) AS w FROM p JOIN f USING (doc_id, term) JOIN n USING (doc_id)),
hn AS (SELECT doc_id, start, sqrt(sum(w * w)) AS norm FROM h GROUP BY ALL), questions AS (SELECT item_id AS question, text FROM benchmark ORDER BY item_id LIMIT 4),
q AS (SELECT question, term, count(*)::DOUBLE AS tf FROM (SELECT question, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM questions) GROUP BY ALL),
qw AS (SELECT n.doc_id, question, q.term, tf * (ln((1.0::DOUBLE + chunks) / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS w FROM n CROSS JOIN q LEFT JOIN f ON f.doc_id = n.doc_id AND f.term = q.term),
qn AS (SELECT doc_id, question, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
s AS (SELECT qw.doc_id, question, start, sum(qw.w * h.w) AS dot FROM qw JOIN h ON h.doc_id = qw.doc_id AND h.term = qw.term GROUP BY ALL),
e AS (SELECT c.doc_id, qs.question, c.start, round(coalesce(dot / hn.norm / qn.norm, 0), 6) AS score FROM c CROSS JOIN questions qs LEFT JOIN s ON s.doc_id = c.doc_id AND s.question = qs.question AND s.start = c.start
  LEFT JOIN hn ON hn.doc_id = c.doc_id AND hn.start = c.start LEFT JOIN qn ON qn.doc_id = c.doc_id AND qn.question = qs.question)
SELECT doc_id, question, CAST(row_number() OVER (PARTITION BY doc_id, question ORDER BY score DESC, start) AS INTEGER) AS rank, CAST(start AS INTEGER) AS start, score FROM e QUALIFY rank <= 2""")
def top_two_chunks(spark, d):
    """The two best chunks of every document for four fixed questions, idf among the document's own chunks."""
    questions = table(spark, d, "benchmark").orderBy("item_id").limit(4).select(F.col("item_id").alias("question"), "text")
    return chunks.top_listed(chunks.listed(table(spark, d, "documents"), "doc_id", "text", 600, 100), "doc_id", questions, 2)


# models: squared hinge, saved, checked for leaks


def _labelled(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return materialised(table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id"))


def _halved(spark, d):
    """(train, test), dealt by the ids; texts are joined once."""
    ids = table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    dealt = split.stratified_split(ids, "label", "doc_id", [("train", 0.8), ("test", 0.2)])
    rows = materialised(table(spark, d, "documents").select("doc_id", "text").join(dealt, "doc_id"))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


@query()
def svc_squared_hinge(spark, d):
    """Loss and gradient at the optimum of the squared-hinge classifier, and its metrics on the test rows."""
    train, test = _halved(spark, d)
    vocabulary = materialised(text_model.fit_vocabulary(train, "doc_id", "text"))
    vectors = materialised(text_model.vectorise(train, "doc_id", "text", vocabulary))
    weights, model = text_model.fit_classifier(vectors, vocabulary)
    scored = text_model.score(text_model.vectorise(test, "doc_id", "text", vocabulary), "doc_id", weights, model.intercept)
    row = metrics.confusion(scored, F.col("label"), F.col("predicted")).join(metrics.average_precision(scored, "label", "score"), F.lit(True))
    return row.withColumns({"loss": F.lit(model.loss), "gradient_norm": F.lit(model.gradient_norm), "newton_steps": F.lit(model.newton_steps)})


_CENTROID = rf"""WITH t AS (SELECT doc_id, label, regexp_extract_all(lower(text), '{W}') AS w FROM documents JOIN (SELECT doc_id, toxic AS label FROM labels) USING (doc_id)), n AS (SELECT count(*)::DOUBLE AS n FROM t),
p AS (SELECT doc_id, label, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, label, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM t) GROUP BY ALL),
v AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM p, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * any_value(n) ORDER BY sum(tf) DESC, term LIMIT 2000),
r AS (SELECT doc_id, label, term, tf * idf AS x FROM p JOIN v USING (term)), u AS (SELECT doc_id, label, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM r),
k AS (SELECT count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg FROM t),
g AS (SELECT term, coalesce(sum(x) FILTER (label = 1), 0) / any_value(pos) - coalesce(sum(x) FILTER (label = 0), 0) / any_value(neg) AS weight FROM u, k GROUP BY term)"""


@query(f"{_CENTROID} SELECT t.doc_id, round(coalesce(sum(x * weight), 0), 6) AS score FROM t LEFT JOIN u USING (doc_id) LEFT JOIN g USING (term) GROUP BY 1")
def saved_model_scores(spark, d):
    """Scores of a model that was written to disk and loaded again: the difference of the classes' mean vectors."""
    rows, root = _labelled(spark, d), _folder(spark, "models")
    vocabulary = materialised(text_model.fit_vocabulary(rows, "doc_id", "text", 2_000))
    vectors = text_model.vectorise(rows, "doc_id", "text", vocabulary)
    sizes = rows.agg(F.sum(F.col("label")).cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    each = vectors.select("label", F.explode(F.arrays_zip("indices", "values")).alias("x")).join(F.broadcast(sizes), F.lit(True))
    share = F.when(F.col("label") == 1, F.col("x.values") / F.col("pos")).otherwise(-F.col("x.values") / F.col("neg"))
    weights = each.groupBy(F.col("x.indices").alias("index")).agg(F.sum(share).alias("weight"))
    models.save(root, "centroids", {"vocabulary": vocabulary, "weights": weights}, {"intercept": 0.0, "grams": 2})
    parts, meta = models.load(spark, root, "centroids")
    again = text_model.vectorise(rows, "doc_id", "text", parts["vocabulary"])
    return text_model.score(again, "doc_id", parts["weights"], meta["intercept"]).select("doc_id", F.round("score", 6).alias("score"))


@query()
def leak_checks(spark, d):
    """F1 of refits on half of the rows, on permuted labels, and without training rows that test rows are near to."""
    train, test = _halved(spark, d)
    return leakage.checks(train, test, newton_steps=15, cg_steps=25, tolerance=1e-4)


# jobs that were cut, and services that fail


@query(rf"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{W}'))::INTEGER AS words FROM documents")
def resumed_job(spark, d):
    """Words of every document, by a job of eight batches that was cut after three and went on."""
    folder = _folder(spark, "resumable")
    resumable.prepare(table(spark, d, "documents").select("doc_id", "text"), "doc_id", folder, 8)
    work = lambda rows: rows.select("doc_id", F.size(T.word_tokens(F.col("text"))).alias("words"), "batch")
    resumable.process(spark, folder, work, stop_after=3)
    resumable.process(spark, folder, work, at_once=2)
    return resumable.table(spark, folder, "doc_id long, words int").select("doc_id", "words")


@query("""WITH k AS (SELECT o_orderkey AS key, CAST(o_orderkey % 4 AS INTEGER) AS fails, o_orderstatus AS payload FROM orders), a AS (SELECT *, unnest(range(1, least(fails + 1, 3) + 1)) AS attempt FROM k)
SELECT key, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt <= fails THEN -1 ELSE length(payload) END::INTEGER AS choice, CASE WHEN attempt <= fails THEN 'TimeoutError: attempt ' || attempt ELSE payload END AS raw,
CASE WHEN attempt <= fails THEN 0.0 ELSE attempt * 0.25 END::DOUBLE AS seconds, attempt <= fails AS failed, CASE attempt WHEN 1 THEN 0.0 WHEN 2 THEN 0.125 ELSE 0.25 END::DOUBLE AS waited FROM a""")
def retried_calls(spark, d):
    """Every attempt at a service that refuses an order up to three times, from a stream of orders."""
    stream = table_stream(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("payload"))
    return retry.stream_with_retries(stream, retry.FailsFirst(4, 0.25), _folder(spark, "retries"), attempts=3, base=0.125)


_MESSAGES = "(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'schema' WHEN page_id % 11 = 0 THEN 'no url' WHEN page_id % 13 = 0 THEN 'dates' WHEN page_id % 17 = 0 THEN 'empty' END AS reason FROM pages)"


@query(f"SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'quarantine' END AS sink, coalesce(reason, '') AS reason, count(*) AS n FROM {_MESSAGES} GROUP BY ALL")
def dead_letters(spark, d):
    """Trigger messages made from pages: those that can't be used go to a quarantine, the stream goes on."""
    stream = table_stream(spark, d, "pages")
    url, day = F.col("url"), F.lit("2024-02-01")
    whole = F.to_json(F.struct(url.alias("url"), day.alias("start_date"), F.when(F.col("page_id") % 13 == 0, F.lit("2024-01-01")).otherwise("2024-02-02").alias("end_date")))
    value = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit('{"url": "'), url)).when(F.col("page_id") % 11 == 0, F.lit('{"entity_type": "news"}')).when(F.col("page_id") % 13 == 0, whole).when(F.col("page_id") % 17 == 0, F.lit("  ")).otherwise(whole)
    good, bad = jobs.run_with_quarantine(stream.select(value.alias("value")), _folder(spark, "messages"))
    rows = good.select(F.lit("good").alias("sink"), F.lit("").alias("reason")).unionByName(bad.select(F.lit("quarantine").alias("sink"), "reason"))
    return rows.groupBy("sink", "reason").agg(F.count("*").alias("n"))


# streams

_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * k AS start FROM events, (SELECT unnest(range(0, 4)) AS k))
GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_sliding(spark, d):
    """Counts and sums by type in days that start every six hours, as the stream closes them."""
    return jobs.run_once(jobs.sliding(jobs.events_stream(spark, d)), _folder(spark, "sliding")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= {_CLOSED}""")
def stream_sessions(spark, d):
    """Each user's sessions of events less than thirty minutes apart, as the stream closes them."""
    return jobs.run_once(jobs.sessions(jobs.events_stream(spark, d)), _folder(spark, "sessions")).select("user_id", "start", "end", "n", F.round("total", 6).alias("total"))


@query("""SELECT b.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS""")
def stream_followed(spark, d):
    """Purchases within twelve hours of the same user's clicks: two streams joined on an interval."""
    first, then = (jobs.events_stream(spark, d).where(F.col("event_type") == x) for x in ("click", "purchase"))
    return jobs.run_once(jobs.followed_within(first, then, "12 HOURS"), _folder(spark, "followed")).select("user_id", "first_id", "then_id")


#: Spark judges a part's rows by the watermark that the part before it was judged by, that is by the parts before both.
_ARRIVALS = "e AS (SELECT *, least((day(ts) - 1) // 8 + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END, 3) AS arrival, date_trunc('day', ts) AS start FROM events)"


@query(f"""WITH {_ARRIVALS}, m AS (SELECT a.arrival, max(e.ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT arrival FROM e) a LEFT JOIN e ON e.arrival < a.arrival - 1 GROUP BY 1)
SELECT start, event_type, count(*) AS n FROM e JOIN m USING (arrival) WHERE mark IS NULL OR start + INTERVAL 1 DAY > mark GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_late_rows(spark, d):
    """Daily counts of a stream in four parts, of which every fiftieth event comes two parts too late."""
    return late_arrivals(spark, d)[0].select("start", "event_type", "n")


def late_arrivals(spark, d):
    """(windows, refused rows) of the events dealt into four files that arrive one after the other."""
    folder = _folder(spark, "arrivals")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8) + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0), F.lit(3))
    for i in range(4):
        e.where(part == i).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    return jobs.run_counting_late(jobs.tumbling(stream), f"{folder}/out")


# page search


def _site(spark, d):
    """Listing pages of twenty orders, newest first, of seven portals."""
    articles = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("portal"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return materialised(page_search.listing(articles, "portal", [F.desc("day"), F.col("o_orderkey")], 20))


_SITE = "(SELECT o_custkey % 7 AS portal, o_orderdate::DATE AS day, CAST((row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1) // 20 + 1 AS INTEGER) AS page FROM orders)"


@query(f"SELECT portal, max(page) AS last, true AS few_asked FROM {_SITE} GROUP BY 1")
def search_last_page(spark, d):
    """The last page of each portal from answers to single pages, asked at most 2 log2(n) + 3 times."""
    site = _site(spark, d)
    found = page_search.last_page(page_search.table_source(site), site.select("portal"))
    return found.select("portal", "last", (F.col("asked") <= 2 * F.log2(F.greatest("last", F.lit(1))) + 3).alias("few_asked"))


@query(f"SELECT portal, min(page) AS first, max(page) AS last FROM (SELECT portal, page FROM {_SITE} GROUP BY 1, 2 HAVING min(day) <= DATE '1996-06-15' AND max(day) >= DATE '1996-06-15') GROUP BY 1")
def search_pages_of_day(spark, d):
    """The pages of each portal whose dates span a day, by bisection."""
    site = _site(spark, d)
    return page_search.pages_of_day(page_search.table_source(site), site.select("portal"), "1996-06-15")


# measures and letters


@query("""WITH t AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT sum(n)::DOUBLE AS total FROM t), a AS (SELECT source, sum(n)::DOUBLE AS a FROM t GROUP BY 1), b AS (SELECT lang, sum(n)::DOUBLE AS b FROM t GROUP BY 1),
x AS (SELECT a, b, total, unnest(range(greatest(1, (a + b - total)::BIGINT), least(a, b)::BIGINT + 1))::DOUBLE AS k FROM a, b, s),
e AS (SELECT sum(k / total * ln(total * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) - lgamma(total + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(total - a - b + k + 1))) AS e FROM x),
h AS (SELECT (SELECT -sum(a / total * ln(a / total)) FROM a, s) AS hc, (SELECT -sum(b / total * ln(b / total)) FROM b, s) AS hl, (SELECT -sum(n / total * ln(n / total)) FROM t, s) AS hj)
SELECT round(e, 6) AS expected, round((hc + hl - hj - e) / ((hc + hl) / 2 - e), 6) AS adjusted_mutual FROM e, h""")
def adjusted_mutual(spark, d):
    """Agreement of sources and languages beyond chance."""
    x = table(spark, d, "documents").select("source", "lang")
    e = metrics.expected_mutual_information(x, "source", "lang").select(F.round("expected", 6).alias("expected"))
    return metrics.adjusted_mutual_information(x, "source", "lang").select(F.round("adjusted_mutual", 6).alias("adjusted_mutual")).join(e, F.lit(True))


_MARKED = "translate(text, 'aerouyzn', 'āěřőůỹžň')"


@query(f"SELECT doc_id, md5(strip_accents({_MARKED})) AS md5, length(strip_accents({_MARKED})) AS n_chars FROM documents")
def accents_nfd(spark, d):
    """Texts with many marked letters, without their marks."""
    x = table(spark, d, "documents").select("doc_id", unicode.without_marks(F.translate("text", "aerouyzn", "āěřőůỹžň"), "nfd").alias("t"))
    return x.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("md5"), F.length("t").cast("long").alias("n_chars"))


@query("SELECT doc_id, md5(strip_accents(replace(text, 'c', 'č'))) AS md5 FROM documents")
def accents_nfkd(spark, d):
    """Texts with ligatures, full-width and raised characters, spelt out and without marks."""
    marked = F.replace(F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("2"), F.lit("²")), F.lit("s"), F.lit("ｓ")), F.lit("c"), F.lit("č"))
    x = table(spark, d, "documents").select("doc_id", unicode.without_marks(marked, "nfkd").alias("t"))
    return x.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("md5"))
