"""Ranked search of all documents for each item: a join seeded with thresholds from stored impacts.

A term's impact in a document is its part of the score. Of each item term the ``STORED`` highest impacts are kept with
their documents. What these lists give a document is no more than its score, so the k-th highest of such sums bounds
the item's k-th score from below (one list alone gives its own k-th impact). The item's terms are ordered from rare to
common; behind the place where the highest impacts of all that follow add up to less than the bound, a term can't bring
a document in that has none of the terms before. Only the terms before it propose documents; those whose sum so far
and the bound of the rest reach the threshold are scored exactly, over all terms.

One pass of the documents counts their terms (Arrow); all else is joins over these counts. Documents stay where they
are: the item terms are broadcast while they are few (``BROADCAST_TERMS`` rows, counted), else both sides are shuffled
by term, and the pass keeps all terms of a document.

Defined results: null and wordless texts hold no term and are not counted; an item without terms, or whose terms no
document holds, has no row; rows that repeat item_id and text are one item, an item_id with several texts is ranked once
for each; every document row is ranked, also where ids repeat; null ids come after all others among equal scores;
empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, scratch

#: Highest impacts kept of each item term; more raise the thresholds.
STORED = 100
#: Rows of (item, term), and of candidates, that are broadcast at most (some 20 MB).
BROADCAST_TERMS = 200_000
#: Texts whose terms a task holds at a time.
TEXTS_AT_ONCE = 512
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of digits, letters A-Z in lower case, and all that isn't ASCII."""
    return text.translate(_TABLE).split()


def counted(rows: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """The row's columns but text, n (terms with repeats) and parallel arrays ``terms`` and ``tfs`` of its terms.

    With a vocabulary, only its terms are listed; n counts all.
    """
    own = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)
    known = rows.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                n, ends, flat, tfs = [], [0], [], []
                for text in batch.column("text").cast(pa.binary()):
                    words = terms_of(text.as_py() or b"")
                    counts = Counter(words if known is None else filter(known.value.__contains__, words))
                    n.append(len(words))
                    flat += counts.keys()
                    tfs += counts.values()
                    ends.append(len(flat))
                terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(n, pa.int64()), terms, listed], names=[*own, "n", "terms", "tfs"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own)
    return rows.select(*[F.col(f"`{c}`") for c in own], "text").mapInArrow(run, f"{schema}, n long, terms array<string>, tfs array<int>")


def _postings(held: DataFrame, *columns: str) -> DataFrame:
    return held.select(*columns, "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(*columns, "n", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))


def search(documents: DataFrame, items: DataFrame, k: int = 20, stored: int = STORED, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 of each item, ties by doc_id."""
    spark = documents.sparkSession
    with scratch(spark) as keep:
        asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
        asked = materialise(counted(asked).withColumn("item", F.monotonically_increasing_id()), "search-items")
        wanted = materialise(_postings(asked, "item").select("item", "term", F.col("tf").alias("times")), "search-item-terms")
        small = wanted.count() <= broadcast_terms
        few = F.broadcast if small else lambda df: df
        vocabulary = frozenset(r.term.encode() for r in wanted.select("term").distinct().collect()) if small else None

        texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        held = materialise(counted(texts, vocabulary).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "search-counts")
        docs, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = _postings(held).groupBy("term").agg(F.count("*").alias("df"))
        terms = df.join(few(wanted.select("term").distinct()), "term", "left_semi")
        weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
        terms = materialise(terms.withColumn("weight", weight).where("weight > 0"), "search-terms")

        m = F.expr(f"100 - 25 + ((25 * n * {docs}L) div {length}L)")
        impact = F.expr("weight * ((1000000000 * tf) div (1000 * tf + 12 * m))")
        impacts = _postings(held.withColumn("n", m), "row").withColumnRenamed("n", "m").join(few(terms.select("term", "weight")), "term").select("row", "term", impact.alias("impact"))

        by_impact = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
        lists = materialise(impacts.withColumn("place", F.row_number().over(by_impact)).where(F.col("place") <= max(stored, k)), "search-lists")
        best = terms.join(lists.where("place = 1").select("term", F.col("impact").alias("most")), "term")
        asks = materialise(wanted.join(few(best), "term").select("item", "term", "times", "df", "weight", (F.col("times") * F.col("most")).alias("bound")), "search-asks")

        seeds = lists.join(few(asks.select("item", "term", "times")), "term").groupBy("item", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("sum"))
        kth = seeds.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum")))).where(F.col("place") == k).select("item", F.col("sum").alias("least"))
        behind = F.sum("bound").over(Window.partitionBy("item").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
        judged = asks.join(few(kth), "item", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).withColumn("behind", behind)
        proposing = judged.where("behind >= least").withColumn("rest", F.min(F.col("behind") - F.col("bound")).over(Window.partitionBy("item")))
        proposing = materialise(proposing.select("item", "term", "times", "least", "rest"), "search-proposing")

        met = impacts.join(few(proposing), "term").groupBy("item", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("sum"), F.first("least").alias("least"), F.first("rest").alias("rest"))
        candidates = materialise(met.where("sum + rest >= least").select("item", "row"), "search-candidates")
        named = F.broadcast(candidates) if candidates.count() <= broadcast_terms else candidates
        exact = _postings(held.withColumn("n", m).join(named, "row"), "item", "row", "doc_id").withColumnRenamed("n", "m")
        exact = exact.join(few(asks.select("item", "term", "times", "weight")), ["item", "term"])
        scores = exact.groupBy("item", "row", "doc_id").agg(F.sum(F.col("times") * impact).alias("score")).where("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = materialise(ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "search-ranked")
        keep.append(out)
    return out
