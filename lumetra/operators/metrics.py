"""Classification, ranking and clustering metrics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1; 0 where undefined."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def attribute_accuracy(pairs: DataFrame, attributes: list[str], gold: str = "gold", found: str = "found") -> DataFrame:
    """A row an attribute: rows, the share whose structs ``gold`` and ``found`` agree in it, and the macro mean of the shares.

    Two nulls agree, a null and a value don't; without rows the shares are null.
    """
    agree = [F.avg(F.col(f"{gold}.`{a}`").eqNullSafe(F.col(f"{found}.`{a}`")).cast("double")) for a in attributes]
    shares = pairs.agg(F.count("*").alias("rows"), F.array(*agree).alias("shares"))
    macro = F.aggregate("shares", F.lit(0.0), lambda t, x: t + x) / len(attributes)
    named = F.arrays_zip(F.lit(list(attributes)).alias("attribute"), F.col("shares").alias("share"))
    each = shares.select("rows", F.round(macro, 6).alias("macro_accuracy"), F.explode(named).alias("x"))
    return each.select(F.col("x.attribute").alias("attribute"), "rows", F.round("x.share", 6).alias("accuracy"), "macro_accuracy")


def confusion(df: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and the metrics, in all or by group."""
    n = lambda c: F.count_if(c)
    counts = df.groupBy(*(by or [])).agg(n((label == 1) & (predicted == 1)).alias("tp"), n((label == 0) & (predicted == 1)).alias("fp"), n((label == 1) & (predicted == 0)).alias("fn"), n((label == 0) & (predicted == 0)).alias("tn"))
    return counts.withColumns({k: F.round(v, 6) for k, v in prf(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()})


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with their rows and positives, and the running totals from the highest score down.

    Scores are dealt by range; each range sums inside and starts from the totals of those before it, of which the
    driver sees one row a partition. No task orders all scores.
    """
    steps = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    dealt = checkpointed(steps.repartitionByRange(F.desc(score)).withColumn("__part", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("__part").agg(F.sum("n"), F.sum("pos")).collect())
    carried, n, pos = [], 0, 0
    for part, more, more_pos in sums:
        carried.append((part, n, pos))
        n, pos = n + more, pos + (more_pos or 0)
    w = Window.partitionBy("__part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)

    def start(i: int) -> Column:
        pairs = [x for c in carried for x in (F.lit(c[0]), F.lit(c[i]))]
        return F.element_at(F.create_map(*pairs), F.col("__part")) if pairs else F.lit(0)

    return dealt.withColumns({"above": F.sum("n").over(w) + start(1), "tp": F.coalesce(F.sum("pos").over(w), F.lit(0)) + start(2)}).drop("__part")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of recall steps times precision, ties together."""
    s = _by_score(df, label, score)
    return s.agg(F.round(F.sum(F.col("pos").cast("double") * F.col("tp") / F.col("above")) / F.sum("pos"), 6).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half."""
    s = _by_score(df, label, score)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg.cast("double") * (F.col("tp") - F.col("pos")) + neg.cast("double") * F.col("pos") / 2)
    return s.agg(F.round(wins / (F.sum("pos").cast("double") * F.sum(neg)), 6).alias("roc_auc"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The score from which predicting 1 gives the highest F1; the highest such score on ties."""
    s = _by_score(df, label, score).crossJoin(F.broadcast(df.agg(F.sum(label).alias("all_pos"))))
    f1 = F.round(2 * F.col("tp").cast("double") / (F.col("above") + F.col("all_pos")), 9)
    return s.withColumn("f1", f1).agg(F.max_by(score, F.struct("f1", score)).alias("threshold"), F.round(F.max("f1"), 6).alias("f1"))


def retrieval(ranks: DataFrame, rank: str = "rank", ks=(1, 5, 10, 20, 50)) -> DataFrame:
    """Recall at k, MRR over all and over found, lost share and mean rank of found; null ranks are lost."""
    r = F.col(rank)
    at = [F.round(F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("queries"), *at, F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(1.0 / r), 6).alias("mrr_found"), F.round(F.avg(r.isNull().cast("int")), 6).alias("lost"), F.round(F.avg(r), 6).alias("mean_rank"))


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(cluster, label).agg(F.count("*").alias("n"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    t = contingency(df, cluster, label).groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return t.agg(F.round(F.sum("top").cast("double") / F.sum("n"), 6).alias("purity"))


def agreement(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Homogeneity, completeness, V-measure and adjusted Rand index from the contingency table."""
    t = contingency(df, cluster, label)
    total = t.agg(F.sum("n").cast("double").alias("n"))
    pairs = lambda c: c.cast("double") * (c - 1) / 2

    def side(column: str, name: str) -> DataFrame:
        m = t.groupBy(column).agg(F.sum("n").alias("m")).crossJoin(F.broadcast(total))
        return m.agg((-F.sum(F.col("m") / F.col("n") * F.log(F.col("m") / F.col("n")))).alias(f"h_{name}"), F.sum(pairs(F.col("m"))).alias(f"p_{name}"))

    joint = t.crossJoin(F.broadcast(total)).agg((-F.sum(t["n"] / total["n"] * F.log(t["n"] / total["n"]))).alias("h_joint"), F.sum(pairs(t["n"])).alias("p_joint"))
    x = joint.crossJoin(side(cluster, "c")).crossJoin(side(label, "l")).crossJoin(total)
    mutual = F.col("h_c") + F.col("h_l") - F.col("h_joint")
    hom = F.when(F.col("h_l") > 0, mutual / F.col("h_l")).otherwise(1.0)
    com = F.when(F.col("h_c") > 0, mutual / F.col("h_c")).otherwise(1.0)
    expected = F.col("p_c") * F.col("p_l") / pairs(F.col("n"))
    most = (F.col("p_c") + F.col("p_l")) / 2
    ari = F.when(most != expected, (F.col("p_joint") - expected) / (most - expected)).otherwise(1.0)
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    return x.select(*[F.round(c, 6).alias(n) for c, n in ((hom, "homogeneity"), (com, "completeness"), (v, "v_measure"), (ari, "adjusted_rand"))])


#: Terms of the expected mutual information that a task adds up at a time.
TERMS = 1_000_000


def _expected_terms(a: int, b: int, n: int, first: int, last: int) -> float:
    """The share of cells of ``first`` to ``last`` rows in the expected mutual information of margins a and b.

    The hypergeometric probability is worked out at ``first`` and carried on by the ratio of neighbours.
    """
    lg = math.lgamma
    k = np.arange(first, last + 1, dtype=float)
    start = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(first + 1) - lg(a - first + 1) - lg(b - first + 1) - lg(n - a - b + first + 1)
    steps = np.log((a - k[:-1]) * (b - k[:-1])) - np.log((k[:-1] + 1) * (n - a - b + k[:-1] + 1))
    chance = np.exp(start + np.concatenate([[0.0], np.cumsum(steps)]))
    return float((k / n * np.log(n * k / (a * b)) * chance).sum())


def expected_mutual_information(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row, ``expected``: the mean mutual information of clusters and labels of the same sizes dealt by chance.

    Equal margins give equal terms, so each pair of different sizes is worked out once and counted; a pair's cells are
    cut into ranges of ``TERMS``. Nothing in the tails is left out.
    """
    t = contingency(df, cluster, label)
    sizes = lambda c, name: t.groupBy(c).agg(F.sum("n").alias(name)).groupBy(name).agg(F.count("*").alias(f"{name}_times"))
    total = t.agg(F.sum("n").alias("total"))
    # a row for each pair of different sizes: there are at most sqrt(2 n) of them on either side
    pairs = sizes(cluster, "a").join(sizes(label, "b"), F.lit(True)).join(F.broadcast(total), F.lit(True))
    low, high = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("total")), F.least("a", "b")
    ranges = pairs.withColumn("high", high).withColumn("first", F.explode(F.sequence(low, high, F.lit(TERMS))))
    ranges = ranges.withColumn("last", F.least(F.col("first") + (TERMS - 1), F.col("high"))).select("a", "b", "total", "first", "last", (F.col("a_times") * F.col("b_times")).alias("times"))

    def run(batches):
        for x in batches:
            parts = [_expected_terms(*map(int, r)) for r in zip(x["a"], x["b"], x["total"], x["first"], x["last"], strict=True)]
            yield pd.DataFrame({"part": np.array(parts, float) * x["times"].to_numpy(float)})

    return ranges.mapInPandas(run, "part double").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("expected"))


def adjusted_mutual_information(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row, ``adjusted_mutual``: (MI - expected MI) / (mean entropy - expected MI); 1 where both sides are one group, or no row."""
    t = contingency(df, cluster, label)
    total = F.broadcast(t.agg(F.sum("n").cast("double").alias("total")))
    share = lambda x: F.col(x) / F.col("total")
    entropy = lambda c, name: t.groupBy(c).agg(F.sum("n").alias("m")).join(total, F.lit(True)).agg(F.coalesce(-F.sum(share("m") * F.log(share("m"))), F.lit(0.0)).alias(name), F.count("*").alias(f"{name}_groups"))
    joint = t.join(total, F.lit(True)).agg(F.coalesce(-F.sum(share("n") * F.log(share("n"))), F.lit(0.0)).alias("h"))
    x = entropy(cluster, "hc").join(entropy(label, "hl"), F.lit(True)).join(joint, F.lit(True)).join(expected_mutual_information(df, cluster, label), F.lit(True))
    mutual, mean = F.col("hc") + F.col("hl") - F.col("h"), (F.col("hc") + F.col("hl")) / 2
    spread = mean - F.col("expected")
    bound = F.when(spread < 0, F.least(spread, F.lit(-2.220446049250313e-16))).otherwise(F.greatest(spread, F.lit(2.220446049250313e-16)))
    alone = (F.col("hc_groups") == F.col("hl_groups")) & (F.col("hc_groups") <= 1)
    return x.select(F.when(alone, 1.0).otherwise((mutual - F.col("expected")) / bound).alias("adjusted_mutual"))
