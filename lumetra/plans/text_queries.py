"""Queries over the string, date and markup functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import markup as H
from ..functions import text as T
from ..operators import gazetteer as G
from ..sources.tables import table
from .registry import query

ACC, PLA = T.ACCENTED, T.PLAIN
BL = r"[\s\x{00A0}]+"


def _docs(spark, d):
    return table(spark, d, "documents")


def _mixed(spark, d):
    """Document texts with a link appended, so that link rules have something to remove."""
    return _docs(spark, d).select("doc_id", F.concat(F.lit("See https://a.example/x?y=1 "), "text", F.lit(" www.b.example  end")).alias("text"))


MIXED = "(SELECT doc_id, 'See https://a.example/x?y=1 ' || text || ' www.b.example  end' AS text FROM documents)"


@query(rf"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{BL}', ' ', 'g')) AS norm FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("norm"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '{BL}', ' ', 'g')) AS norm, lower(trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '{BL}', ' ', 'g'))) AS title FROM {MIXED}")
def dedup_norm(spark, d):
    return _mixed(spark, d).select("doc_id", T.dedup_norm(F.col("text")).alias("norm"), T.title_norm(F.col("text")).alias("title"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query(rf"SELECT doc_id, regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g') AS plain FROM {MIXED}")
def strip_urls(spark, d):
    return _mixed(spark, d).select("doc_id", T.strip_urls(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, translate(text, '{ACC}', '{PLA}') AS folded FROM documents")
def accent_fold(spark, d):
    return _docs(spark, d).select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(rf"""SELECT doc_id, coalesce(array_to_string(list_filter(regexp_extract_all(translate(lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g')), '{ACC}', '{PLA}'),
  '\d+(?:[.,]\d+)+|[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*'), lambda t: NOT list_contains([{_STOP}], t)), ' '), '') AS processed FROM {MIXED}""")
def heavy_preprocess(spark, d):
    return _mixed(spark, d).select("doc_id", T.heavy_preprocess(F.col("text")).alias("processed"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '{BL}', ' ', 'g')) AS processed FROM {MIXED}")
def light_preprocess(spark, d):
    return _mixed(spark, d).select("doc_id", T.light_preprocess(F.col("text")).alias("processed"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '[!-/:-@\[-`{{-~]', '', 'g'), '{BL}', ' ', 'g')) AS cleaned FROM pages")
def legacy_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.legacy_clean(F.col("html")).alias("cleaned"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.PT_TOKEN}')) AS BIGINT) AS n, array_to_string(regexp_extract_all(text, '{T.PT_TOKEN}'), '|') AS tokens FROM documents")
def pt_tokens(spark, d):
    t = T.pt_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{T.WORD}')) AS BIGINT) AS n, array_to_string(regexp_extract_all(lower(text), '{T.WORD}'), '|') AS tokens FROM documents")
def word_tokens(spark, d):
    t = T.word_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(translate(lower(text), '{ACC}', '{PLA}')), '[.!?;:]+$', ''), '{BL}', ' ', 'g')) AS norm FROM documents")
def identity_norm(spark, d):
    return _docs(spark, d).select("doc_id", T.identity_norm(F.col("text")).alias("norm"))


def _notices(spark, d):
    o = table(spark, d, "orders")
    number = F.concat(F.lpad((F.col("o_orderkey") % 500).cast("string"), 4, "0"), F.lit("/"), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", number.alias("number"), F.concat(F.lit("O edital n. "), F.regexp_replace(number, "/19", "/20"), F.lit(" e o pregão "), F.lit("CC"), F.regexp_replace(number, "/19..", "/2013")).alias("text"))


_NUMBER = "lpad(CAST(o_orderkey % 500 AS VARCHAR), 4, '0') || '/' || CAST(year(o_orderdate) AS VARCHAR)"


@query(rf"""WITH t AS (SELECT o_orderkey, 'O edital n. ' || regexp_replace({_NUMBER}, '/19', '/20', 'g') || ' e o pregão CC' || regexp_replace({_NUMBER}, '/19..', '/2013', 'g') AS text FROM orders),
f AS (SELECT o_orderkey, regexp_extract_all(text, '(?i)\b(?:n\.?|nº)?\s*([A-Z]{{0,3}}\d+/20[12]\d)\b', 1) AS a FROM t)
SELECT o_orderkey, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS editals FROM f""")
def edital_extract(spark, d):
    return _notices(spark, d).select("o_orderkey", F.array_join(T.editals(F.col("text")), "|").alias("editals"))


@query(f"""SELECT o_orderkey, CASE WHEN ltrim(split_part(n, '/', 1), '0') = '' THEN '0' ELSE ltrim(split_part(n, '/', 1), '0') END || '/' || split_part(n, '/', 2) AS norm FROM (SELECT o_orderkey, {_NUMBER} AS n FROM orders)""")
def edital_norm(spark, d):
    return _notices(spark, d).select("o_orderkey", T.edital_norm(F.col("number")).alias("norm"))


_PORTAL = r"""CASE WHEN trim(coalesce(url, '')) = '' THEN '(sem link)' WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), 'www\.', '', 'g') = '' THEN '(sem dominio)' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), 'www\.', '', 'g') END"""


@query(f"SELECT page_id, {_PORTAL} AS portal FROM pages")
def portal_of_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.portal(F.col("url")).alias("portal"))


_GROUPS = {"src0": "ndmais_bulk", "src1": "nsc_volume", "src2": "official_minority", "src3": "official_minority"}


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'ndmais_bulk' WHEN source = 'src1' THEN 'nsc_volume' WHEN source IN ('src2', 'src3') THEN 'official_minority' ELSE 'other' END AS grp FROM documents")
def portal_group(spark, d):
    return _docs(spark, d).select("doc_id", T.portal_group(F.col("source"), _GROUPS).alias("grp"))


_SEM, _STY = ["ation", "ing", "ment"], ["the", "que", "der"]


@query("""SELECT term, CASE WHEN contains(term, 'ation') OR contains(term, 'ing') OR contains(term, 'ment') THEN 'semantic_fraud' WHEN contains(term, 'the') OR contains(term, 'que') OR contains(term, 'der') THEN 'stylized_portal' ELSE 'other' END AS cls
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)""".replace("\\\\", "\\"))
def feature_class(spark, d):
    terms = _docs(spark, d).select(F.explode(T.word_tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.feature_class(F.col("term"), _SEM, _STY).alias("cls"))


_MON = "list_value(" + ", ".join(f"'{m}'" for m in D.MONTHS) + ")"


def _dates(spark, d):
    o = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    month = F.element_at(F.lit(D.MONTHS), F.month("dt"))
    day = F.dayofmonth("dt").cast("string")
    year = F.year("dt").cast("string")
    return o.select(
        "o_orderkey",
        F.element_at(F.array(F.concat(F.date_format("dt", "yyyy-MM-dd"), F.lit("T23:38:34-03:00")), F.concat(day, F.lit(" "), F.substring(month, 1, 3), F.lit(" "), year, F.lit(" às 14h38")), F.concat(month, F.lit(" "), day, F.lit(", "), year)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("iso_or_portuguese"),
        F.concat(F.date_format("dt", "dd/MM/yyyy"), F.lit(" - 10:00")).alias("dmy"),
        F.concat(F.date_format("dt", "dd/MM/yyyy"), F.lit(" 10h00Atualizado agora")).alias("g1"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("dt", "dd/MM/yyyy"), F.lit(" às 09h30Atualizada 10h"))).otherwise(F.concat(day, F.lit(" de "), month, F.lit(" de "), year)).alias("other"),
    )


def _date_query(kind):
    sql = "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published FROM orders"
    name = {"iso_or_portuguese": "date_iso_pt", "dmy": "date_dmy", "g1": "date_g1", "other": "date_other"}[kind]
    query(sql, name)(lambda spark, d: _dates(spark, d).select("o_orderkey", D.PARSERS[kind](F.col(kind)).cast("string").alias("published")))


for _kind in D.PARSERS:
    _date_query(_kind)


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published FROM orders")
def date_dispatch(spark, d):
    """Each row by the parser its key names."""
    names = F.lit(list(D.PARSERS))
    x = _dates(spark, d).withColumn("parser", F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")))
    raw = None
    for k in D.PARSERS:
        raw = F.when(F.col("parser") == k, F.col(k)) if raw is None else raw.when(F.col("parser") == k, F.col(k))
    return x.select("o_orderkey", D.first_parseable(F.col("parser"), [F.lit("sem data"), raw]).cast("string").alias("published"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')), ''), 'sem-titulo') AS title FROM pages".replace("\\\\", "\\"))
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.first_text(F.col("html"), "h1", "sem-titulo").alias("title"))


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM pages""")
def html_content(spark, d):
    return table(spark, d, "pages").select("page_id", H.all_texts(F.col("html"), "article", "p").alias("content"))


@query(r"""SELECT DISTINCT page_id, regexp_extract(href, '^[^?#]*') AS link FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), 'href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/') AND href <> '/' AND NOT contains(href, 'ing')""")
def html_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(H.links(F.col("html"), "nav")).alias("href")).where(T.accepted_link(F.col("href"), ["/"], ["ing"]))
    return links.select("page_id", F.regexp_extract("href", r"^[^?#]*", 0).alias("link")).distinct()


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE coalesce(json_extract_string(props, '$.k'), '') END AS modalities FROM events")
def json_coerce(spark, d):
    """Model answers of several shapes read as arrays of strings."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    shapes = F.array(F.concat(F.lit('{"modalidade": "'), k, F.lit('"}')), F.concat(F.lit('{"modalidade": '), k, F.lit("}")), F.concat(F.lit('```json\n{"modalidade": ["'), k, F.lit('", "'), k, F.lit('", ""]}\n```')), F.lit("no json"))
    answer = F.element_at(shapes, (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.array_join(T.json_strings(answer, "modalidade"), "|").alias("modalities"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS w FROM documents), h AS (SELECT doc_id, w[1:len(w) // 2 + 1] AS a, w[len(w) // 2 + 2:] AS b FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS pos, a[i + 1] AS left_item, b[i + 1] AS right_item FROM (SELECT doc_id, a, b, unnest(range(0, greatest(len(a), len(b)))) AS i FROM h)""")
def list_align(spark, d):
    """The words of a text's first half, its middle word included, beside those of the rest."""
    words = _docs(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int") + 1
    a = words.select("doc_id", F.slice("w", F.lit(1), half).alias("a"), F.slice("w", half + 1, F.size("w")).alias("b"))
    return a.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).select("doc_id", "pos", F.col("x.a").alias("left_item"), F.col("x.b").alias("right_item"))


@query(r"""SELECT doc_id, CASE WHEN m = '' OR TRY_CAST(m AS INTEGER) IS NULL OR TRY_CAST(m AS INTEGER) > 10 THEN -1 ELSE TRY_CAST(m AS INTEGER) END AS choice FROM (SELECT doc_id, regexp_extract('Resposta: ' || CAST(doc_id % 14 AS VARCHAR) || '. ' || text, '\b\d+\b') AS m FROM documents)""")
def answer_parse(spark, d):
    a = F.concat(F.lit("Resposta: "), (F.col("doc_id") % 14).cast("string"), F.lit(". "), F.col("text"))
    return _docs(spark, d).select("doc_id", T.answer_choice(a, F.lit(10)).alias("choice"))


_PLACES = ["licensed under", "all rights reserved", "the", "de la", "und", "mit license", "public license"]


@query(r"""SELECT doc_id, name FROM documents, (SELECT unnest(['licensed under', 'all rights reserved', 'the', 'de la', 'und', 'mit license', 'public license']) AS name)
WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || name || '($|[^\p{L}\p{N}_])')""")
def gazetteer_match(spark, d):
    names = spark.createDataFrame([(x,) for x in _PLACES], "name string")
    return G.whole_word_matches(_docs(spark, d), names)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 200")
def length_filter(spark, d):
    return _docs(spark, d).where(F.length("text") > 200).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT wanted.doc_id, documents.source IS NOT NULL AS found, source FROM (SELECT unnest([3, 5, 7, 100000007, 11, 42]) AS doc_id) wanted LEFT JOIN documents ON documents.doc_id = wanted.doc_id".replace("SELECT wanted.doc_id", "SELECT CAST(wanted.doc_id AS BIGINT) AS doc_id"))
def id_lookup(spark, d):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 7, 100000007, 11, 42)], "doc_id long")
    found = F.broadcast(ids).join(_docs(spark, d).select("doc_id", "source"), "doc_id", "left")
    return found.select("doc_id", F.col("source").isNotNull().alias("found"), "source")


@query("SELECT doc_id, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'licensed') ORDER BY doc_id LIMIT 20")
def text_search(spark, d):
    """First 20 rows that hold a phrase, with the number of all."""
    hits = _docs(spark, d).where(F.contains(F.lower("text"), F.lit("licensed"))).select("doc_id")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("doc_id").limit(20).crossJoin(F.broadcast(total))


@query()
def chunk_text(spark, d):
    """Overlapping chunks of every document at natural separators."""
    from ..functions import python_udfs as U

    chunks = U.recursive_chunks()(F.col("text"))
    return _docs(spark, d).select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query()
def stem_preprocess(spark, d):
    """Heavy preprocessing with Portuguese suffix stemming; numbers stay."""
    from ..functions import python_udfs as U

    return _docs(spark, d).select("doc_id", F.array_join(U.stemmed()(T.heavy_tokens(F.col("text"))), " ").alias("processed"))
