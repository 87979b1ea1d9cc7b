"""A stored vector index of cells, searched exactly by bounds of the triangle inequality.

``build`` fits cell centres on a bounded sample (``SAMPLE`` vectors in hash order), gives every vector to its nearest
centre and writes one Parquet folder, partitioned by cell: unit vectors, their distance to the centre, and a block
number that keeps a cell's rows in pieces of about ``BLOCK``, so a cell that holds a third of all rows is many tasks.
A second small table has each cell's centre, radius and size.

``search`` is two joins of (query, cell) visits with the index. The first visits the nearest cells of each query that
hold enough rows and gives a distance that the k-th neighbour can't exceed. The second visits those cells whose
nearest possible row, distance to the centre less the radius, is within it; rows whose own distance to the centre
proves them farther are left out before anything is multiplied. What bounds leave out is worse by more than the
rounding, so the result is that of comparing all.

Defined results: null vectors and vectors of length zero are not indexed and find nothing; equal cosines go to the
smaller id; a base of fewer than k rows gives all of them; an empty base gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .split import hash_order

#: Vectors that centres are fitted on, rows of a block, queries that are multiplied at once, and queries that a task holds.
SAMPLE, BLOCK, QUERIES, HELD = 20_000, 4_096, 1_024, 32_768
#: Cosines are rounded to six places; bounds leave room for it.
SLACK = 2e-6


def unit(rows: DataFrame) -> DataFrame:
    """``rows`` (id, v) with vectors of length one; others go."""
    v = F.transform("v", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("id", v.alias("v")).where("v IS NOT NULL").withColumn("__n", norm).where(F.col("__n") > 0).select("id", F.transform("v", lambda x: x / F.col("__n")).alias("v"))


def fit_centres(vectors: DataFrame, cells: int, rounds: int = 8, seed: int = 5, sample: int = SAMPLE) -> np.ndarray:
    """Centres of at most ``cells`` cells by k-means over a bounded sample."""
    held = vectors.orderBy(hash_order(seed, F.col("id"))).limit(sample).select("v").collect()
    if not held:
        return np.empty((0, 0))
    x = np.array([r.v for r in held], float)
    centres = [x[0]]
    far = ((x - x[0]) ** 2).sum(axis=1)
    draw = np.random.default_rng(seed)
    while len(centres) < min(cells, len(x)) and far.max() > 1e-12:
        centres.append(x[draw.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = _nearest(x, c)[0]
        sizes = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(axis=1))


def build(vectors: DataFrame, folder: str, cells: int = 64, sample: int = SAMPLE, block: int = BLOCK) -> None:
    """Write the index of (id, v) under ``folder``: rows by cell, and the cells."""
    rows = unit(vectors)
    centres = fit_centres(rows, cells, sample=sample)
    spark = vectors.sparkSession

    def place(batches):
        for batch in batches:
            if len(batch):
                cell, away = _nearest(np.stack(batch["v"].to_numpy()), centres)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "cell": cell.astype("int32"), "away": away})

    placed = rows.mapInPandas(place, "id long, v array<double>, cell int, away double") if len(centres) else rows.selectExpr("id", "v", "0 AS cell", "0D AS away")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/placed")
    held = _rows(spark, f"{folder}/placed")
    sizes = held.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block)
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(named), "cell").withColumn("blocks", blocks.cast("int")).write.mode("overwrite").parquet(f"{folder}/cells")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<double>, away double, cell int").parquet(path)


def visits(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(q, qv, cell, n, blocks, centre_at, least): each query's distance to every cell, and to its nearest possible row."""
    away = F.sqrt(F.aggregate(F.zip_with("qv", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = queries.select(F.col("id").alias("q"), F.col("v").alias("qv")).join(F.broadcast(cells), F.lit(True))
    return pairs.withColumn("centre_at", away).withColumn("least", F.greatest(F.col("centre_at") - F.col("radius"), F.lit(0.0))).drop("centre", "radius")


def _multiply(asked: DataFrame, index: DataFrame, cells: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """(q, id, cos): each visit's k best rows within its limit; ``asked`` has q, qv, cell, blocks, centre_at and within.

    Queries are dealt to ``parts``, each of which meets all blocks, so that no task holds all queries of a cell.
    """
    blocks = index.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    a = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("q", "qv", "cell", "block", "part", "centre_at", "within")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.empty(0, "int64"), "id": np.empty(0, "int64"), "cos": np.empty(0)})]
        if len(x) and len(y):
            y = y.sort_values("id")
            v, ids, away = np.stack(y["v"].to_numpy()), y["id"].to_numpy(), y["away"].to_numpy()
            for at in range(0, len(x), QUERIES):
                z = x.iloc[at : at + QUERIES]
                centre, within = z["centre_at"].to_numpy(), z["within"].to_numpy()
                near = np.abs(centre[:, None] - away[None]) <= within[:, None]
                some = near.any(axis=0)
                cos = np.where(near[:, some], np.round(np.stack(z["qv"].to_numpy()) @ v[some].T, 6), -2.0)
                order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                own = np.take_along_axis(cos, order, axis=1)
                i, j = np.nonzero(own > -2)
                out.append(pd.DataFrame({"q": z["q"].to_numpy()[i], "id": ids[some][order[i, j]], "cos": own[i, j]}))
        return pd.concat(out)

    return a.groupBy("cell", "block", "part").cogroup(blocks.groupBy("cell", "block", "part")).applyInPandas(best, "q long, id long, cos double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plan(queries: DataFrame, folder: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first round's visits (the nearest cells that hold k rows together) and all visits of the queries."""
    spark = queries.sparkSession
    cells = spark.read.schema("cell int, radius double, n long, centre array<double>, blocks int").parquet(f"{folder}/cells")
    all_visits = visits(unit(queries), cells)
    w = Window.partitionBy("q").orderBy("centre_at", "cell").rowsBetween(Window.unboundedPreceding, -1)
    return all_visits.where("true").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < k).drop("before"), all_visits


def search(queries: DataFrame, folder: str, k: int = 10, held: int = HELD) -> DataFrame:
    """(a, b, rank, cos): the k nearest indexed rows of each query (id, v), exactly; a task holds about ``held`` queries."""
    from ..sources.shared import materialised

    spark = queries.sparkSession
    cells = spark.read.schema("cell int, radius double, n long, centre array<double>, blocks int").parquet(f"{folder}/cells")
    index = _rows(spark, f"{folder}/placed")
    first, every = plan(queries, folder, k)
    parts = max(1, -(-queries.count() // held))
    start = materialised(_top(_multiply(first.withColumn("within", F.lit(4.0)), index, cells, k, parts), k))
    kth = start.where(F.col("rank") == k).select("q", "cos")
    rest = second_visits(first, every, kth)
    more = _multiply(rest, index, cells, k, parts)
    out = _top(start.select("q", "id", "cos").unionByName(more), k)
    return out.select(F.col("q").alias("a"), F.col("id").alias("b"), "rank", "cos")


def second_visits(first: DataFrame, every: DataFrame, kth: DataFrame) -> DataFrame:
    """Visits not made yet whose nearest possible row is within the k-th distance found; all where k rows weren't found."""
    limit = F.sqrt(F.greatest(2 - 2 * (F.col("cos") - SLACK), F.lit(0.0)))
    left = every.join(first.select("q", "cell"), ["q", "cell"], "left_anti").join(kth, "q", "left")
    return left.withColumn("within", F.coalesce(limit, F.lit(4.0))).where("least <= within").drop("cos")
