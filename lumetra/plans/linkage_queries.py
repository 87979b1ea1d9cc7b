"""Queries over retrieval, near duplicates and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, linkage, metrics
from ..sources.shared import materialised
from ..sources.tables import table
from .registry import query

W = T.WORD
_BASE_W = rf"""
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, count(*) AS df, ln(((SELECT n FROM n) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM p GROUP BY 1),
bw AS (SELECT p.doc_id, p.term, tf / max(tf) OVER (PARTITION BY p.doc_id) * idf AS w FROM p JOIN idf USING (term)),
bn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM bw GROUP BY 1),
qp AS (SELECT item_id, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT item_id, qp.term, tf / max(tf) OVER (PARTITION BY item_id) * coalesce(idf, 1) AS w FROM qp LEFT JOIN idf USING (term)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
dots AS (SELECT item_id AS query_id, doc_id, round(sum(qw.w / qn.norm * (bw.w / bn.norm)), 6) AS score FROM qw JOIN qn USING (item_id) JOIN bw USING (term) JOIN bn USING (doc_id) GROUP BY 1, 2)"""


def _passages(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _linked(spark, d, k=50):
    return linkage.tfidf_top_k(_passages(spark, d), table(spark, d, "documents").select("doc_id", "text"), k)


_LINKED = f"""WITH {_BASE_W}, s AS (SELECT b.item_id AS query_id, documents.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents LEFT JOIN dots ON dots.query_id = b.item_id AND dots.doc_id = documents.doc_id),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50)"""


@query(f"{_LINKED} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def linkage_topk(spark, d):
    """Benchmark passages against all documents: top 50 by TF-IDF cosine, zero scores kept."""
    return _linked(spark, d).select("query_id", "doc_id", "score", "rank")


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents ON contains(documents.text, b.text))"


#: Proposed pairs of passage and document, and passages, that are broadcast (of 16 bytes, and of a text each).
BROADCAST_PROPOSED, BROADCAST_PASSAGES = 1_000_000, 20_000


def _run(w, i, n):
    return F.xxhash64(*[F.get(w, i + j) for j in range(n)])


def _runs(words, sizes):
    """64-bit names of all runs of ``sizes`` words of an expression, which is worked out once a row."""
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: _run(w, i, n))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(words), lambda w: F.array_distinct(F.flatten(F.array(*[of(w, n) for n in sizes])))), 1)


def _gold(spark, d):
    """Documents that hold a whole passage.

    Such a document holds the words inside it that blanks end on both sides, and so all their runs of three (of fewer,
    where there are fewer). The rarest run of each passage is the key of an equi-join, and what it proposes is checked
    on the characters, where the document stands: no text is shuffled while the pairs are few enough to be broadcast. A passage of one or two words has no word that blanks must end: these are a query set of their
    own, each looked for in every document.
    """
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = b.withColumn("w", F.split("passage", " "))
    inner = words.where(F.size("w") >= 3).select("query_id", F.slice("w", F.lit(2), F.size("w") - 2).alias("w"))
    keyed = inner.select("query_id", F.explode(F.when(F.size("w") >= 3, _runs(F.col("w"), [3])).when(F.size("w") == 2, _runs(F.col("w"), [2])).otherwise(_runs(F.col("w"), [1]))).alias("key"))
    sizes = [r.n for r in inner.select(F.least(F.size("w"), F.lit(3)).alias("n")).distinct().collect()]  # of 1, 2 and 3
    proven = None
    if sizes:
        keys = keyed.select("key").distinct()
        few = F.broadcast if keyed.count() <= 500_000 else (lambda x: x)
        places = materialised(docs.select("doc_id", F.explode(_runs(F.split("text", " "), sizes)).alias("key")).join(few(keys), "key", "left_semi"))
        rarity = places.groupBy("key").agg(F.count("*").alias("n"))
        rarest = keyed.join(rarity, "key").groupBy("query_id").agg(F.min(F.struct("n", "key")).alias("r"), F.count("*").alias("met"))
        # a run that no document has rules its passage out
        rarest = rarest.join(keyed.groupBy("query_id").agg(F.countDistinct("key").alias("due")), "query_id").where("met >= due").select("query_id", F.col("r.key").alias("key"))
        proposed = materialised(places.join(few(rarest), "key").select("query_id", "doc_id").distinct())
        near, asked = proposed, b
        if proposed.count() <= BROADCAST_PROPOSED and b.count() <= BROADCAST_PASSAGES:
            near, asked = F.broadcast(proposed), F.broadcast(b)
        proven = docs.join(near, "doc_id").join(asked, "query_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    bare = words.where(F.size("w") < 3).join(docs, F.contains("text", "passage")).select("query_id", "doc_id")
    return (bare if proven is None else proven.unionByName(bare)).distinct()


@query(f"""{_LINKED}, {_GOLD}, r AS (SELECT g.query_id, min(rank) AS rank FROM gold g LEFT JOIN top ON top.query_id = g.query_id AND top.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) AS queries, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 5, 10, 20, 50))}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(1.0::DOUBLE / rank), 6) AS mrr_found,
round(avg(CASE WHEN rank IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS lost, round(avg(rank), 6) AS mean_rank FROM r""")
def retrieval_metrics(spark, d):
    """Rank of the best gold document of each passage, and what the ranks come to."""
    found = _gold(spark, d).join(_linked(spark, d).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return metrics.retrieval(found.groupBy("query_id").agg(F.min("rank").alias("rank")))


@query(f"""WITH {_GOLD}, first AS (SELECT query_id, min(doc_id) AS doc_id FROM gold GROUP BY 1), k AS (SELECT query_id, source, lang FROM first JOIN documents USING (doc_id))
SELECT policy, count(*) AS pairs, count(DISTINCT k.query_id) AS queries, count(g.doc_id) AS gold FROM k CROSS JOIN (SELECT unnest(['strict', 'relaxed']) AS policy) JOIN documents b ON b.source = k.source AND (policy = 'relaxed' OR b.lang = k.lang)
LEFT JOIN gold g ON g.query_id = k.query_id AND g.doc_id = b.doc_id GROUP BY 1""")
def block_policies(spark, d):
    """How many candidates and gold documents the strict and the relaxed block keep."""
    gold = _gold(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    keys = gold.groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).join(docs, "doc_id").select("query_id", "source", "lang")
    hit = gold.withColumn("hit", F.lit(1))
    out = None
    for policy, on in (("strict", ["source", "lang"]), ("relaxed", ["source"])):
        x = keys.select("query_id", *on).join(docs.select("doc_id", *on), on).join(hit, ["query_id", "doc_id"], "left")
        x = x.agg(F.count("*").alias("pairs"), F.countDistinct("query_id").alias("queries"), F.count("hit").alias("gold")).withColumn("policy", F.lit(policy))
        out = x if out is None else out.unionByName(x)
    return out


@query(rf"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY 1")
def doc_freq(spark, d):
    return linkage.postings(table(spark, d, "documents"), "doc_id", T.word_tokens(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_BASE_W} SELECT count(*) AS terms, round(min(idf), 6) AS least, round(max(idf), 6) AS most, round(avg(idf), 6) AS mean, round(median(idf), 6) AS median FROM idf")
def idf_model(spark, d):
    x = table(spark, d, "documents")
    idf = linkage.idf_model(linkage.postings(x, "doc_id", T.word_tokens(F.col("text"))), x.count())
    return idf.agg(F.count("*").alias("terms"), *[F.round(f("idf"), 6).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"), (F.median, "median"))])


_TFIDF = rf"""WITH p AS (SELECT doc_id AS id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM p GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents)),
f AS (SELECT * FROM st ORDER BY total DESC, term LIMIT 10000),
v AS (SELECT id, p.term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (df + 1.0::DOUBLE)) + 1) AS w FROM p JOIN f USING (term)),
x AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v)"""


def _vectors(spark, d, max_features=10_000, terms=T.word_tokens):
    x = table(spark, d, "documents").select("doc_id", "text")
    return dedup.features(x, terms(F.col("text")), x.count(), max_features)


@query(f"{_TFIDF} SELECT id, term, round(w, 6) AS w FROM x")
def tfidf_vectors(spark, d):
    vectors, vocabulary = _vectors(spark, d)
    vectors = vectors.select("id", F.explode(F.arrays_zip("terms", "ws")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.ws").alias("w"))
    named = vectors.join(F.broadcast(vocabulary.select(F.col("index").alias("term"), "word")), "term")
    return named.select("id", F.col("word").alias("term"), F.round("w", 6).alias("w"))


_PAIRS = f"{_TFIDF}, pr AS (SELECT a.id AS i, b.id AS j FROM x a JOIN x b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.9)"


@query(f"{_PAIRS} SELECT DISTINCT j AS id FROM pr")
def near_dup_any_earlier(spark, d):
    """Documents that an earlier one is alike to (cosine 0.9)."""
    return dedup.any_earlier(*dedup.leading_pairs(_vectors(spark, d)[0], 0.9))


@query()
def near_dup_greedy(spark, d):
    """Documents that an earlier kept one is alike to, by words and pairs of adjacent words."""
    pairs, members = dedup.leading_pairs(_vectors(spark, d, terms=T.word_grams)[0], 0.9)
    return dedup.greedy_leader(pairs).unionByName(dedup.later_copies(members))


_DESC = "WITH qs AS (SELECT p_partkey AS query_id, p_brand || '/' || p_type AS block, p_name || ' ' || p_type AS q FROM part WHERE p_partkey % 50 = 0), bs AS (SELECT p_partkey AS doc_id, p_brand || '/' || p_type AS block, p_type || ' ' || p_name AS b FROM part)"


def _descriptions(spark, d):
    p = table(spark, d, "part").withColumn("block", F.concat("p_brand", F.lit("/"), "p_type"))
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), "block", F.concat("p_name", F.lit(" "), "p_type").alias("q"))
    return q, p.select(F.col("p_partkey").alias("doc_id"), "block", F.concat("p_type", F.lit(" "), "p_name").alias("b"))


_TOK = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{W}'))"
_INTER = f"len(list_intersect({_TOK('q')}, {_TOK('b')}))::DOUBLE"
_GRAMS = lambda c: "list_distinct(flatten([" + ", ".join(f"[substr({c}, i, {n}) FOR i IN range(1, length({c}) - {n} + 2)]" for n in (2, 3, 4, 5)) + "]))"
_SCORES = {
    "jaccard": f"{_INTER} / len(list_distinct(list_concat({_TOK('q')}, {_TOK('b')})))",
    "dice": f"2 * {_INTER} / (len({_TOK('q')}) + len({_TOK('b')}))",
    "overlap": f"{_INTER} / least(len({_TOK('q')}), len({_TOK('b')}))",
    "levenshtein": "1 - levenshtein(q, b)::DOUBLE / greatest(length(q), length(b), 1)",
    "charngram": f"len(list_intersect({_GRAMS('q')}, {_GRAMS('b')}))::DOUBLE / len(list_distinct(list_concat({_GRAMS('q')}, {_GRAMS('b')})))",
}


def _method(name):
    sql = f"{_DESC} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round({_SCORES[name]}, 6) AS score FROM qs JOIN bs USING (block)) QUALIFY rank <= 10"
    query(sql, f"retrieval_{name}")(lambda spark, d: linkage.retrieval_top_k(*_descriptions(spark, d), name, 10))


for _name in _SCORES:
    _method(_name)


@query(f"{_DESC} SELECT query_id, doc_id, round(jaro_winkler_similarity(q, b), 6) AS score FROM qs JOIN bs USING (block)")
def jaro_winkler(spark, d):
    return linkage.every_score(*_descriptions(spark, d), "jaro_winkler")


@query(rf"""WITH p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN dl USING (doc_id), s GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10""")
def retrieval_bm25(spark, d):
    return linkage.top_k(linkage.bm25(_passages(spark, d), table(spark, d, "documents").select("doc_id", "text")), 10).select("query_id", "doc_id", "score", "rank")


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def _halves(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.where("id % 5 = 0"), e.where("id % 5 <> 0")


@query(f"SELECT a.vec_id AS a, arg_max(b.vec_id, {_COS} - b.vec_id * 1e-12::DOUBLE) AS b, max({_COS}) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY 1")
def nn_cosine(spark, d):
    """Each test vector's nearest train vector."""
    return linkage.nearest(*_halves(spark, d))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 AND {_COS} >= 0.35")
def sim_pairs_dense(spark, d):
    """Test and train vectors with a cosine of at least 0.35."""
    return linkage.nearest(*_halves(spark, d), threshold=0.35)


_CHOICE = "(CAST(('0x' || substr(md5(CAST(query_id AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) % 1000)"


@query(f"""{_DESC}, c AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM qs JOIN bs USING (block)), h AS (SELECT *, {_CHOICE} AS choice, (rank - 1) // 5 AS g FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY choice DESC, rank) AS r FROM h QUALIFY r = 1)
SELECT query_id, arg_min(doc_id, rank - choice * 1000000) AS chosen, count(*) AS groups FROM w GROUP BY 1""")
def tournament_winner(spark, d):
    """Groups of five and a final, decided by a hash in place of a model."""
    h = lambda q, b: F.conv(F.substring(F.md5(F.concat(q.cast("string"), F.lit(":"), b.cast("string"))), 1, 6), 16, 10).cast("long") % 1000
    return linkage.block_tournament(*_descriptions(spark, d), h)


_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '\\S+'))"


@query(f"""{_DESC}, t AS (SELECT query_id, q, b, row_number() OVER (PARTITION BY query_id ORDER BY round({_SCORES['jaccard']}, 6) DESC, doc_id) AS rank FROM qs JOIN bs USING (block) QUALIFY rank <= 10),
s AS (SELECT query_id, rank, len(list_intersect({_WORDS('q')}, {_WORDS('b')})) AS shared FROM t), m AS (SELECT query_id, count(*) AS n, max(shared) AS most FROM s GROUP BY 1),
c AS (SELECT query_id, CAST(CASE WHEN any_value(n) < 2 THEN any_value(n) WHEN any_value(most) = 0 THEN 0 ELSE min(rank) FILTER (shared = most) END AS INTEGER) AS choice FROM s JOIN m USING (query_id) GROUP BY 1)
SELECT query_id, choice, CASE WHEN choice > 0 THEN 'chosen' WHEN choice = 0 THEN 'abstain' ELSE 'fail' END AS outcome FROM c""")
def single_call_rerank(spark, d):
    """Top-10 candidates of each description query, chosen by the lexical stand-in."""
    q, b = _descriptions(spark, d)
    top = linkage.retrieval_top_k(q, b, "jaccard", 10).join(b.select("doc_id", "b"), "doc_id").join(q.select("query_id", "q"), "query_id")
    cache = top.groupBy("query_id").agg(F.first("q").alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]).alias("candidates"))
    return linkage.rerank(cache, linkage.LexicalReranker())
