"""How five quality filters act together in every order: a histogram of failure masks.

Native expressions turn each text into a mask of the filters that it fails; equal texts are found by a groupBy on
their digest, which gives the smallest doc_id of each text. Rows of one text share the first four bits, so they are
counted by part and label before any two of them meet, and a text with any number of copies is a few rows. What is
left is at most 32 cells a part (rows, good rows, toxic rows); all 120 orders are read off the cells, since what a set
of filters keeps doesn't depend on their order.

Defined results: a null text is the empty text, a null source the part ''; a null doc_id is neither smaller nor larger
than any other, so it never fails E and makes nobody fail; rows that repeat id and text are rows of their own that all
pass E if none is smaller; several labels of one id count as their highest; labels without a document are ignored; an
empty table has no part and no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column, words: Column) -> Column:
    """Bits 1, 2, 4, 8 for too few words, repeated words, many capitals, and signs."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 50, F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 65, capitals * 100 > F.length(text).cast("long") * 5, text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for i, fail in enumerate(fails):
        out = out + F.when(fail, 1 << i).otherwise(0)
    return out


def mask_cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they fail."""
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("key"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})

    same = ["key", "part", "mask", "is_good", "is_toxic"]
    ids = rows.groupBy(*same, "doc_id").agg(F.count("*").alias("c"))
    kinds = ids.groupBy(*same).agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))).alias("unnumbered"))
    # a row for each part and label of a text, however many copies it has
    first = F.min("least").over(Window.partitionBy("key"))
    zero = F.lit(0).cast("long")
    passing = F.coalesce("unnumbered", zero) + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(zero)
    kinds = kinds.withColumn("first", first).withColumn("passing", passing)
    repeats = F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))
    both = kinds.select("part", "is_good", "is_toxic", F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), repeats)).alias("x"))
    both = both.select("part", "x.mask", "x.n", "is_good", "is_toxic").where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(zero))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def orders_from_cells(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from at most 32 cells a part."""
    mask, zero = F.col("mask"), F.lit(0).cast("long")
    kept_by = lambda value: F.array(*[F.sum(F.when(mask.bitwiseAND(s) == 0, F.col(value)).otherwise(zero)) for s in range(ALL + 1)])
    # of the orders of the filters that a row fails, an equal share lets each of them remove it
    shares = F.array(*[F.sum(F.when(mask.bitwiseAND(1 << i) != 0, F.col("n") * (F.lit(len(ORDERS)) / F.bit_count(mask)).cast("long")).otherwise(zero)) for i in range(len(FILTERS))])
    sums = cells.groupBy("part").agg(*[kept_by(v).alias(f"left_{v}") for v in ("n", "good", "toxic")], shares.alias("shares"))
    steps = sums.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substring(filter_order, {}, 1)) - 65)"
    steps = steps.withColumns({"bit": F.expr(bit.format("step")), "upto": F.expr(f"aggregate(transform(sequence(1, step), i -> {bit.format('i')}), 0, (s, x) -> s + x)")})
    before, upto, own = F.col("upto") - F.col("bit"), F.col("upto"), F.col("bit")
    lost = lambda v: F.get(f"left_{v}", before) - F.get(f"left_{v}", upto)
    left = lambda at: F.get("left_n", at)
    return steps.select(
        "part", "filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("filter"), left(upto).alias("kept"), lost("n").alias("removed"),
        (left(F.lit(0)) - left(own) - lost("n")).alias("redundant"), (left(F.lit(ALL) - own) - left(F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.expr("ascii(substring(filter_order, step, 1)) - 65")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders_from_cells(mask_cells(documents, labels))
