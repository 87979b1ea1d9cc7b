"""Evaluation of a linkage run: outcomes of the choosing step, error tables, tournaments, reports of models.

A cache has a row for each candidate (query_id, rank from 1, doc_id); a result has a row for each query with
``answer``: 0 abstains, 1 to n names the candidate of that rank, -1 or anything else is a failure, null was not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(condition: Column, of: Column | None = None) -> Column:
    """Rows that meet a condition, per row (or per row that meets ``of``), 0 where there is none."""
    total = F.count("*") if of is None else F.count_if(of)
    return F.coalesce(F.round(F.count_if(condition if of is None else condition & of) / F.nullif(total, F.lit(0)), 6), F.lit(0.0))


def gold_ranks(cache: DataFrame, gold: DataFrame, top: int | None = None) -> DataFrame:
    """query_id, candidates and the best rank of a gold document (null where none is among the first ``top``)."""
    seen = cache if top is None else cache.where(F.col("rank") <= top)
    marked = seen.join(gold.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    best = marked.groupBy("query_id").agg(F.count("*").alias("candidates"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("gold_rank"))
    return gold.select("query_id").distinct().join(best, "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def outcomes(ranks: DataFrame, results: DataFrame) -> DataFrame:
    """Each query's answer beside its gold rank: outcome is chosen, abstained or failed; correct where it names gold."""
    joined = ranks.join(results.select("query_id", "answer"), "query_id", "left")
    chosen = F.col("answer").between(1, F.col("candidates"))
    named = F.when(chosen, "chosen").when(F.col("answer") == 0, "abstained").otherwise("failed")
    return joined.withColumn("outcome", named).withColumn("correct", chosen & F.coalesce(F.col("answer") == F.col("gold_rank"), F.lit(False)))


def canonical(cache: DataFrame, gold: DataFrame, results: DataFrame, top: int = 10) -> DataFrame:
    """One row: precision at 1 and match among ``top`` of the baseline, outcomes and accuracies of the choosing step, its gain."""
    o = outcomes(gold_ranks(cache, gold, top), results)
    is_ = lambda x: F.col("outcome") == x
    base, found = F.coalesce(F.col("gold_rank") == 1, F.lit(False)), F.col("gold_rank").isNotNull()
    row = o.agg(
        F.count("*").alias("queries"), share(base).alias("baseline_p1"), share(found).alias("match_top"), F.count_if(is_("abstained")).alias("zeros"), F.count_if(is_("failed")).alias("failures"),
        F.count_if(is_("chosen")).alias("chosen"), F.count_if(F.col("correct")).alias("correct"), share(F.col("correct")).alias("accuracy"), share(F.col("correct"), found).alias("accuracy_with_candidates"),
    )
    return row.withColumn("gain", F.round(F.col("accuracy") - F.col("baseline_p1"), 6))


def error_table(cache: DataFrame, gold: DataFrame, results: DataFrame, base: DataFrame, top: int = 50) -> DataFrame:
    """Wrong answers with the chosen and the gold description; the gold's comes from the candidates, else from the base."""
    wrong = outcomes(gold_ranks(cache, gold, top), results).where(~F.col("correct"))
    named = cache.where(F.col("rank") <= top).join(base.select("doc_id", F.col("description").alias("from_cache")), "doc_id", "left")
    picked = named.select("query_id", F.col("rank").alias("answer"), F.col("from_cache").alias("chosen_description"))
    listed = named.select("query_id", F.col("doc_id").alias("gold_id"), "from_cache")
    one = gold.groupBy("query_id").agg(F.min("doc_id").alias("gold_id"))
    out = wrong.join(picked, ["query_id", "answer"], "left").join(one, "query_id").join(listed, ["query_id", "gold_id"], "left")
    out = out.join(base.select(F.col("doc_id").alias("gold_id"), F.col("description").alias("from_base")), "gold_id", "left")
    return out.select("query_id", "outcome", "gold_rank", "gold_id", F.coalesce("chosen_description", F.lit("")).alias("chosen_description"), F.coalesce("from_cache", "from_base", F.lit("")).alias("gold_description"))


def seeded_order(seed: int, *key: Column) -> Column:
    """A fixed random order of rows: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def two_group_tournament(cache: DataFrame, seed: int = 42) -> DataFrame:
    """query_id, chosen (rank, 0 abstains, -1 fails), calls: the first ten candidates, shuffled, in two groups of five.

    ``choice`` is what a group's round prefers; a candidate below 0 makes its round fail, and a failed round fails
    the query. A group whose best is 0 abstains. Winners of both groups meet in a final, a lone one needs none.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(seeded_order(seed, F.col("query_id"), F.col("doc_id")), "rank")
    placed = cache.where(F.col("rank") <= 10).withColumn("g", F.floor((F.row_number().over(w) - 1) / 5))
    best = F.max_by(F.struct("rank", "choice"), F.struct("choice", -F.col("rank")))
    groups = placed.groupBy("query_id", "g").agg(best.alias("won"), F.min("choice").alias("least"), F.count("*").alias("n"))
    groups = groups.select("query_id", (F.col("least") < 0).alias("bad"), (F.col("won.choice") > 0).alias("has"), F.col("won.rank").alias("rank"), F.col("won.choice").alias("choice"), (F.col("n") > 1).cast("int").alias("calls"))
    final = groups.groupBy("query_id").agg(F.bool_or("bad").alias("bad"), F.count_if("has").alias("winners"), F.max_by(F.col("rank"), F.when(F.col("has"), F.struct("choice", -F.col("rank")))).alias("rank"), F.sum("calls").alias("calls"))
    chosen = F.when(F.col("bad"), -1).when(F.col("winners") == 0, 0).otherwise(F.col("rank"))
    return final.select("query_id", chosen.cast("int").alias("chosen"), (F.col("calls") + ((F.col("winners") == 2) & ~F.col("bad")).cast("int")).alias("calls"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support for every class, and the macro and weighted means."""
    pairs = df.select(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).groupBy("y", "p").count()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(1).alias("own"), F.lit(0).alias("said")), F.struct(F.col("p").alias("class"), F.lit(0).alias("own"), F.lit(1).alias("said")))).alias("s"), (F.col("y") == F.col("p")).alias("right"), "count")
    per = sides.groupBy("s.class").agg(F.sum(F.col("s.own") * F.col("count")).alias("support"), F.sum(F.col("s.said") * F.col("count")).alias("said"), F.sum(F.when(F.col("right"), F.col("s.own") * F.col("count")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    out = per.select("class", *names, "support").unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, 6).alias(c) for c in names], "support")


def gap_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """class, and for each measure the values of two reports and the second less the first."""
    names = ("precision", "recall", "f1")
    left, right = (d.select("class", *[F.col(c).alias(f"{c}_{s}") for c in names]) for d, s in ((a, "dev"), (b, "test")))
    both = left.join(right, "class", "full")
    return both.select("class", *[F.col(f"{c}_{s}") for c in names for s in ("dev", "test")], *[F.round(F.col(f"{c}_test") - F.col(f"{c}_dev"), 6).alias(f"{c}_gap") for c in names])


def nested_cache(cache: DataFrame, top: int = 50) -> DataFrame:
    """query_id and its first ``top`` candidates as one array in rank order, as the cache table stores it."""
    item = F.struct("rank", "doc_id", "score")
    return cache.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def last_page(listing: DataFrame, page: str = "page", links: str = "n_links") -> DataFrame:
    """portal and its last page that lists a link: what doubling and bisection over the pager look for."""
    return listing.where(F.col(links) > 0).groupBy("portal").agg(F.max(page).alias("max_page"))


def pages_of_date(listing: DataFrame, target: str) -> DataFrame:
    """portal and page of every listing page whose dates span the target (pages run from new to old)."""
    day = F.lit(target).cast("date")
    return listing.groupBy("portal", "page").agg(F.min("day").alias("low"), F.max("day").alias("high")).where((F.col("low") <= day) & (F.col("high") >= day)).select("portal", "page")


def routed(messages: DataFrame) -> DataFrame:
    """Each trigger message with the way it goes: folder, everything, the legacy crawl, or the pages of one date."""
    way = F.when(F.coalesce(F.col("folder"), F.lit("")) != "", "folder").when(F.coalesce(F.col("collect_all"), F.lit(False)), "collect_all").when(F.coalesce(F.col("legacy"), F.lit(False)), "legacy")
    return messages.withColumn("route", way.otherwise("dated"))


def progress(df: DataFrame, done: str, total: str, elapsed: str) -> DataFrame:
    """Items a second and seconds left, null before the first item."""
    rate = F.when((F.col(done) > 0) & (F.col(elapsed) > 0), F.col(done) / F.col(elapsed))
    return df.withColumn("per_second", F.round(rate, 6)).withColumn("seconds_left", F.round((F.col(total) - F.col(done)) / rate, 6))


#: Modalities of tenders in the order of their ids from 0, with the words that name each.
MODALITIES = {
    "Pregão Eletrônico": "pregao eletronico", "Pregão Presencial": "pregao presencial", "Concorrência": "concorrencia", "Tomada de Preços": "tomada de preco", "Convite": "convite", "Leilão": "leilao",
    "Concurso": "concurso", "Dispensa de Licitação": "dispensa", "Inexigibilidade": "inexigibilidade", "Chamamento Público": "chamamento", "Credenciamento": "credenciamento", "Regime Diferenciado": "rdc",
}


def modality(folded: Column) -> Column:
    """The modality that a lower-case accent-free text names first in the list's order; null where none is named."""
    out = None
    for name, words in MODALITIES.items():
        out = F.when(F.contains(folded, F.lit(words)), name) if out is None else out.when(F.contains(folded, F.lit(words)), name)
    return out


def mean_pooled(vectors: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """The mean of the unmasked vectors of each key, by position: partial sums before the shuffle."""
    at = vectors.where(mask).select(key, F.posexplode(vector).alias("i", "x"))
    means = at.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vector))
