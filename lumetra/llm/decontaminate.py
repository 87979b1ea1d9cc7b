"""Benchmark decontamination as a prefix-filtered set join, DataFrame functions only.

Every window of ``window`` consecutive item words is a set of positioned shingles. One pass over the
documents keeps the positions whose shingle occurs in any item; counting them gives each shingle's rarity.
Containment is total (threshold 1), so the necessary prefix of a window is its single rarest shingle: only
the occurrences of that one propose a window. The length and positional bounds then drop proposals that
would start before the document or end after it, and a proposal counts when all the window's shingles stand
at their places, which proves the whole window because neighbouring shingles overlap.

Defined results: null or wordless texts have no words and no hits; a null item text has no windows, a null
item_id counts as the item ``null``; repeated benchmark rows count once by id; each document row gets its
own result row, also where ids repeat or are null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .text import ascii_lower, cased_words

#: Item shingles and (window, item) rows up to this many are broadcast (about 30 MB); beyond it both sides are shuffled.
BROADCAST_SHINGLES = 200_000
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of all items: ``item`` (id as text) and ``win`` (its words, A-Z lower-cased)."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), cased_words(ascii_lower(F.col("text"))).alias("w"))
    words = words.where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    return words.withColumn("at", at).select("item", F.slice("w", F.col("at"), size).alias("win")).distinct()


def _hashed(words: str, at, k: int):
    return F.xxhash64(*[F.lower(F.get(words, at + i)) for i in range(k)])


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(docs, hits): a row per document row with n_words, and the verified window places.

    docs: doc_id, th (text hash), n_words. hits: doc_id, th, start, width, item.
    """
    wins = materialise(item_windows(benchmark, window).groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64("win")), "windows")
    # one bounded row a distinct shingle size: 1 to ``shingle``
    sizes = sorted({r[0] for r in wins.select(F.least(F.size("win"), F.lit(shingle))).distinct().collect()}) or [shingle]
    parts = None
    for k in sizes:
        own = wins.where(F.least(F.size("win"), F.lit(shingle)) == k)
        own = own.select("wid", F.size("win").alias("width"), "win", F.explode(F.sequence(F.lit(0), F.size("win") - k)).alias("offset"))
        own = own.select("wid", "width", "offset", F.concat_ws(" ", F.slice("win", F.col("offset") + 1, k)).alias("shingle"), F.lit(k).alias("k"))
        parts = own if parts is None else parts.unionByName(own)
    parts = materialise(parts, "item-shingles")
    folded = F.split(F.lower("shingle"), " ")
    key = F.when(F.col("k") == sizes[0], F.xxhash64(*[F.get(folded, F.lit(i)) for i in range(sizes[0])]))
    for k in sizes[1:]:
        key = key.when(F.col("k") == k, F.xxhash64(*[F.get(folded, F.lit(i)) for i in range(k)]))
    vocabulary = parts.select("shingle", "k").distinct().withColumn("h", key)
    named = wins.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    small = max(named, vocabulary.count()) <= BROADCAST_SHINGLES

    doc = documents.select("doc_id", F.xxhash64("text").alias("th"), cased_words(F.col("text")).alias("w"))
    seen = None
    for k in sizes:
        # position -1 stands for the document itself, so that one pass also gives every document's n_words
        first = -1 if k == sizes[-1] else 0
        last = F.size("w") - k
        at = doc.select("doc_id", "th", "w", F.explode(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array(F.lit(first)))).alias("pos"))
        at = at.withColumn("h", F.when((F.col("pos") >= 0) & (F.col("pos") + k <= F.size("w")), _hashed("w", F.col("pos"), k)))
        right = vocabulary.where(F.col("k") == k).select("h", "shingle")
        at = at.join(F.broadcast(right) if small else right, "h", "left").where("shingle IS NOT NULL OR pos = -1")
        at = at.select("doc_id", "th", F.size("w").alias("n_words"), "pos", "shingle", F.lit(k).alias("k"), F.when(F.col("pos") >= 0, F.slice("w", F.col("pos") + 1, k)).alias("own"))
        # the join key folds all case; the words themselves are told apart by A-Z lower-casing only
        at = at.where(F.col("own").isNull() | (ascii_lower(F.concat_ws(" ", "own")) == F.col("shingle"))).drop("own")
        seen = at if seen is None else seen.unionByName(at)
    seen = materialise(seen, "seen-shingles")
    docs = seen.where("pos = -1").select("doc_id", "th", "n_words")
    places = seen.where("pos >= 0").distinct()

    rarity = places.groupBy("shingle", "k").agg(F.count("*").alias("n"))
    rare = parts.join(rarity, ["shingle", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a window with a shingle that no document has (n = 0) can't occur
    prefix = rare.groupBy("wid", "width", "k").agg(F.min(F.struct("n", "offset", "shingle")).alias("p")).where("p.n > 0")
    prefix = prefix.select("wid", "width", "k", F.col("p.offset").alias("offset"), F.col("p.shingle").alias("shingle"))
    proposed = places.join(F.broadcast(prefix) if small else prefix, ["shingle", "k"])
    proposed = proposed.withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 AND start + width <= n_words")
    proposed = proposed.select("doc_id", "th", "start", "wid", "width", "k").distinct()

    due = parts.groupBy("wid").agg(F.count("*").alias("due"))
    wanted = proposed.join(F.broadcast(parts.select("wid", "offset", "shingle")) if small else parts.select("wid", "offset", "shingle"), "wid")
    wanted = wanted.select("doc_id", "th", "start", "wid", "width", "k", (F.col("start") + F.col("offset")).alias("pos"), "shingle").alias("a")
    there = places.select("doc_id", "th", "pos", "shingle", "k").alias("b")
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("th", "pos", "shingle", "k")]
    full = wanted.join(there, same).groupBy("a.doc_id", "a.th", "a.start", "a.width", "a.wid").agg(F.count("*").alias("got"))
    proven = full.join(F.broadcast(due) if small else due, "wid").where("got = due")
    bags = wins.select("wid", "items")
    hits = proven.join(F.broadcast(bags) if small else bags, "wid").select("doc_id", "th", "start", "width", F.explode("items").alias("item"))
    return docs, hits


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Per document row: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs, hits = find_hits(documents, benchmark, window, shingle)
    hits = materialise(hits, "hits")
    words = hits.select("doc_id", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("pos")).distinct()
    words = words.groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    items = hits.groupBy("doc_id", "th").agg(F.lit(None).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    both = words.unionByName(items).groupBy("doc_id", "th").agg(F.max("n_hit").alias("n_hit"), F.first("items", ignorenulls=True).alias("items")).alias("h")
    d = docs.alias("d")
    out = d.join(both, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.th") == F.col("h.th")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.th").alias("th"), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.when(F.col("items").isNull(), F.lit(EMPTY_SHA)).otherwise(F.sha2(F.array_join("items", ","), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of ``documents`` without those that hold an item window; columns stay as they are."""
    _, hits = find_hits(documents, benchmark, window, shingle)
    bad = materialise(hits.select("doc_id", "th").distinct(), "contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__th")), "left_anti")
