"""Forests and boosted trees over sparse rows that are not negative, grown with exact splits over every feature.

Training rows that fit a task (``MOST_VALUES``) are sent to all tasks once, and tasks grow the trees or models side by
side; ``ml`` leaves larger tables to Spark's trees. A split of a node is the best of all thresholds between values of
all features (forests: of a random draw of the square root of their number for each node), absent values being zero.
With sums G and H of a side, its worth is G^2 / (H + l): H weights and G weights of the positive rows, that is Gini's
index; for boosting the second-order step of the logistic loss with l = 1, as in the reference's boosting.

A forest's trees don't depend on how many there are, and one cut off at a depth is the tree grown to that depth: a
fold's forest is grown once for all points of the grid.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values other than zero of the training rows that tasks hold at most: some 70 bytes each while a tree grows.
MOST_VALUES = 8_000_000
#: Rows that are looked up at once, trees of a task, least sum of H of a child in boosting.
AT_ONCE, TREES_A_TASK, LEAST = 512, 20, 1.0

PAIR = "struct<indices: array<int>, values: array<double>>"


def listed(rows: DataFrame) -> DataFrame:
    """``rows`` with the vectors ``features`` as parallel arrays of what is not zero."""

    def parts(v):
        if hasattr(v, "indices"):
            return v.indices.tolist(), v.values.tolist()
        return [i for i, x in enumerate(v.toArray()) if x], [float(x) for x in v.toArray() if x]

    return rows.withColumn("__x", F.udf(parts, PAIR)("features"))


class Rows:
    """Sparse rows by (feature, value), with the starts of rows of another copy in order of rows."""

    def __init__(self, sizes: np.ndarray, feats: np.ndarray, values: np.ndarray):
        self.n, self.starts = len(sizes), np.r_[0, np.cumsum(sizes)]
        self.by_row = feats.astype("int32"), values.astype("float32")

    def some(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        at = np.repeat(self.starts[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return Rows(sizes, self.by_row[0][at], self.by_row[1][at])

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(self.n, dtype="int32"), np.diff(self.starts))
        order = np.lexsort((self.by_row[1], self.by_row[0]))
        return row[order], self.by_row[0][order], self.by_row[1][order]

    def dense(self, width: int):
        for s in range(0, self.n, AT_ONCE):
            e = min(s + AT_ONCE, self.n)
            x = np.zeros((e - s, width), "float32")
            lo, hi = self.starts[s], self.starts[e]
            x[np.repeat(np.arange(e - s), np.diff(self.starts[s : e + 1])), self.by_row[0][lo:hi]] = self.by_row[1][lo:hi]
            yield s, e, x


def grow(entries, g: np.ndarray, h: np.ndarray, width: int, depth: int, penalty: float = 0.0, least: float = 0.0, drawn: int | None = None, rng=None):
    """(feature or -1, threshold, left child, value) by node, right children stand after left ones, and the leaf of each row.

    Rows without H are left out.
    """
    row, feat, value = entries  # of what is still open; in order of (feature, value), or in any order where features are drawn
    feature, threshold, left, worth = [-1], [0.0], [-1], [g.sum() / max(h.sum() + penalty, 1e-300)]
    node = np.where(h > 0, 0, -1).astype("int32")  # place among the open nodes of the level
    names, leaf, share = np.array([0]), np.zeros(len(h), "int32"), 1.0
    for _ in range(depth):
        open_rows = node >= 0
        tot_g, tot_h = (np.bincount(node[open_rows], x[open_rows], len(names)) for x in (g, h))
        # nothing is gained where all is alike, nor allowed where a child would be too small
        done = tot_h < 2 * least if penalty else (tot_g <= 1e-9 * tot_h) | (tot_g >= (1 - 1e-9) * tot_h)
        if done.any():
            place = np.where(done, -1, np.cumsum(~done) - 1).astype("int32")
            node = np.where(open_rows, place[node], -1).astype("int32")
            names, tot_g, tot_h = names[~done], tot_g[~done], tot_h[~done]
        m = len(names)
        if not m:
            break
        if drawn:
            if (left_over := node >= 0).mean() < 0.7 * share:  # closed rows are only now and then taken out
                share, alive = left_over.mean(), left_over[row]
                row, feat, value = row[alive], feat[alive], value[alive]
            asked = np.zeros((m + 1, width), bool)  # the last one is of closed rows
            for i in range(m):
                asked[i, rng.choice(width, drawn, replace=False, shuffle=False)] = True
            at = (np.where(node < 0, m, node).astype("int64" if (m + 1) * width >= 2**31 else "int32") * width)[row]
            at += feat
            own = np.flatnonzero(asked.ravel()[at])
            k = node[row[own]]
            order = np.lexsort((value[own], feat[own], k))
            own, k = own[order], k[order]
            f, v, r, own_k = feat[own], value[own], row[own], k
        else:
            k = node[row]
            alive = k >= 0
            if not alive.all():
                row, feat, value, k = row[alive], feat[alive], value[alive], k[alive]
            if m > 1:
                order = np.argsort(k.astype("uint16") if m < 65_536 else k, kind="stable")
                row, feat, value, k = row[order], feat[order], value[order], k[order]
            f, v, r, own_k = feat, value, row, k
        if not len(r):
            break
        new = np.r_[True, (f[1:] != f[:-1]) | (own_k[1:] != own_k[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(r)]
        sizes, heads = last - first, np.flatnonzero(np.r_[True, own_k[1:] != own_k[:-1]])
        at_node, counts = own_k[heads], np.diff(np.r_[heads, len(r)])
        spread = lambda x: np.repeat(x[at_node], counts)
        cum_g, cum_h = np.cumsum(g[r]), np.cumsum(h[r])
        right_g, right_h = np.repeat(cum_g[last - 1], sizes), np.repeat(cum_h[last - 1], sizes)
        right_g[1:] -= cum_g[:-1]
        right_h[1:] -= cum_h[:-1]
        left_g, left_h, floor = spread(tot_g) - right_g, spread(tot_h) - right_h, spread(np.maximum(least, 1e-9 * tot_h))
        bad = (right_h < floor) | (left_h < floor)
        bad[1:] |= (v[1:] == v[:-1]) & ~new[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = right_g * right_g / (right_h + penalty)
            gain += left_g * left_g / (left_h + penalty)
        gain[bad] = -1.0
        top = np.maximum.reduceat(gain, heads)
        plain = tot_g[at_node] ** 2 / (tot_h[at_node] + penalty)
        best = np.flatnonzero(gain == np.repeat(top, counts))
        best = best[np.unique(own_k[best], return_index=True)[1]][top > plain + 1e-9 * np.maximum(plain, 1e-9)]
        if not len(best):
            break
        place = np.full(m, -1, "int32")
        place[own_k[best]] = np.arange(len(best)) * 2
        node = np.where(node >= 0, place[node], -1).astype("int32")
        span = last[np.searchsorted(last, best, side="right")] - best
        node[r[np.repeat(best - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())]] += 1
        children = len(feature) + np.arange(2 * len(best))
        for b, parent, child in zip(best, names[own_k[best]], children[::2], strict=True):
            before = 0.0 if new[b] else float(v[b - 1])
            feature[parent], threshold[parent], left[parent] = int(f[b]), (before + float(v[b])) / 2, int(child)
            feature += [-1, -1]
            threshold += [0.0, 0.0]
            left += [-1, -1]
            worth += [left_g[b] / (left_h[b] + penalty), right_g[b] / (right_h[b] + penalty)]
        names = children
        leaf = np.where(node >= 0, names[node], leaf)
    return (np.array(feature, "int32"), np.array(threshold), np.array(left, "int32"), np.array(worth)), leaf


def looked_up(tree, x: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """The value of each dense row where the tree is cut off at each of the rising depths."""
    feature, threshold, left, worth = tree
    at, rows, out = np.zeros(len(x), int), np.arange(len(x)), []
    for d in range(depths[-1] + 1):
        if d in depths:
            out.append(worth[at])
        inner = feature[at] >= 0
        if not inner.any():
            break
        at = np.where(inner, left[at] + (x[rows, feature[at]] > threshold[at]), at)
    return out + [worth[at]] * (len(depths) - len(out))


def _forest(rows: Rows, y, w, width: int, numbers, depth: int, seed: int):
    entries, drawn = (np.repeat(np.arange(rows.n, dtype="int32"), np.diff(rows.starts)), *rows.by_row), max(1, int(np.ceil(np.sqrt(width))))
    for number in numbers:
        rng = np.random.default_rng([seed, number])
        h = w * np.bincount(rng.integers(rows.n, size=rows.n), minlength=rows.n)
        yield grow(entries, h * y, h, width, depth, drawn=drawn, rng=rng)[0]


def _boosted(rows: Rows, y, w, width: int, rounds: int, depth: int, rate: float):
    entries, w, margin = rows.sorted(), w / (w[y == 0][0] if (y == 0).any() else 1.0), np.zeros(rows.n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        (feature, threshold, left, worth), leaf = grow(entries, w * (y - p), w * p * (1 - p), width, depth, 1.0, LEAST)
        margin += rate * worth[leaf]
        yield feature, threshold, left, rate * worth


class Trees:
    """A fitted model; ``transform`` gives probability and prediction."""

    def __init__(self, kind: str, trees: list, width: int, depth: int):
        self.kind, self.trees, self.width, self.depth, self.stages, self.getNumTrees = kind, trees, width, depth, [self], len(trees)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "stages"}

    def probabilities(self, rows: Rows) -> np.ndarray:
        out = np.zeros(rows.n)
        for s, e, x in rows.dense(self.width):
            total = sum(looked_up(t, x, [self.depth])[0] for t in self.trees)
            out[s:e] = total / len(self.trees) if self.kind == "rf" else 1 / (1 + np.exp(-total))
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        held, kept = rows.sparkSession.sparkContext.broadcast(self), [c for c in rows.columns if c != "features"]

        def run(batches):
            for batch in batches:
                p = held.value.probabilities(_rows_of(batch["__x"]))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(p)], names=[*kept, "__p"])

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept], "__p double"])
        out = listed(rows).select(*kept, "__x").mapInArrow(run, schema)
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), "__p"))).withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")


def _rows_of(x) -> Rows:
    at, values = x.field("indices"), x.field("values")
    return Rows(np.diff(at.offsets.to_numpy()), at.flatten().to_numpy(), values.flatten().to_numpy())


def _tasks(spark, jobs: list, run) -> list:
    """What ``run`` gives for each job, a task each."""

    def each(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(run(jobs[i]))], pa.binary())], names=["id", "out"])

    done = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(each, "id long, out binary").collect()
    return [pickle.loads(r.out) for r in sorted(done, key=lambda r: r.id)]


def _f1(y: np.ndarray, p: np.ndarray) -> float:
    hit = float(((p > 0.5) & (y == 1)).sum())
    return 2 * hit / max(float((p > 0.5).sum() + (y == 1).sum()), 1.0)


def select(kind: str, rows: DataFrame, points: list[dict], folds: int, rounds: int | None = None, seed: int = 42) -> tuple[Trees, list[float], list[float]] | None:
    """(model of the best point on all rows, means, spreads); None where the rows don't fit a task.

    ``rows`` has features, label, weight and fold. A point has depth and trees, for boosting rate too; boosting is compared
    after ``rounds`` rounds (None: all).
    """
    spark = rows.sparkSession
    stored = F.udf(lambda v: int(v.numNonzeros()), "int")("features")
    width, n_values = rows.select(F.udf(len, "int")("features").alias("w"), stored.alias("n")).agg(F.max("w"), F.sum("n")).first()
    if n_values is None or n_values > MOST_VALUES or not width:
        return None

    def pack(batches):
        for batch in batches:
            x = batch["__x"]
            each = np.diff(x.field("indices").offsets.to_numpy()).astype("int32"), x.field("indices").flatten().to_numpy(), x.field("values").flatten().to_numpy().astype("float32"), *(batch[c].to_numpy() for c in ("label", "weight", "fold"))
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in each], names=list("abcdef"))

    held = listed(rows).select("__x", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("fold").cast("int").alias("fold"))
    blocks = held.mapInArrow(pack, ", ".join(f"{c} binary" for c in "abcdef")).collect()
    sizes, at, values, y, w, fold = (np.frombuffer(b"".join(r[c] for r in blocks), t) for c, t in zip("abcdef", ("<i4", "<i4", "<f4", "<f8", "<f8", "<i4"), strict=True))
    order = np.lexsort((at[(np.r_[0, np.cumsum(sizes)[:-1]]).clip(max=max(len(at) - 1, 0))], sizes, y, fold)) if len(at) else np.arange(len(sizes))
    data = spark.sparkContext.broadcast((Rows(sizes, at, values).some(order), y[order], w[order], fold[order]))
    fold, y, deepest = fold[order], y[order], sorted({p["depth"] for p in points})

    def taught(k):
        everything, y, w, fold = data.value
        own = np.flatnonzero(fold != k)
        return everything.some(own), y[own], w[own]

    if kind == "rf":
        counts = sorted({p["trees"] for p in points})
        cuts = sorted({*range(0, counts[-1], TREES_A_TASK), *counts})
        jobs = [(k, a, b) for k in range(folds) for a, b in zip(cuts, cuts[1:], strict=False)]

        def judge(job):
            k, a, b = job
            everything, _, _, fold = data.value
            held_out = everything.some(np.flatnonzero(fold == k))
            trees = list(_forest(*taught(k), width, range(a, b), deepest[-1], seed))
            total = np.zeros((len(deepest), held_out.n))
            for s, e, x in held_out.dense(width):
                for t in trees:
                    total[:, s:e] += looked_up(t, x, deepest)
            return total

        sums = dict(zip(jobs, _tasks(spark, jobs, judge), strict=True))
        share = lambda k, p: sum(v[deepest.index(p["depth"])] for (q, _, b), v in sums.items() if q == k and b <= p["trees"]) / p["trees"]
        scores = [[_f1(y[fold == k], share(k, p)) for k in range(folds)] for p in points]
    else:
        jobs = [(k, i) for i in sorted(range(len(points)), key=lambda i: -points[i]["depth"]) for k in range(folds)]  # the longest first

        def judge(job):
            k, p = job[0], points[job[1]]
            everything, _, _, fold = data.value
            trees = list(_boosted(*taught(k), width, min(rounds or p["trees"], p["trees"]), p["depth"], p["rate"]))
            return Trees("gbt", trees, width, p["depth"]).probabilities(everything.some(np.flatnonzero(fold == k)))

        found = dict(zip(jobs, _tasks(spark, jobs, judge), strict=True))
        scores = [[_f1(y[fold == k], found[k, i]) for k in range(folds)] for i in range(len(points))]
    means = [float(np.mean(s)) for s in scores]
    best = points[int(np.argmax(means))]

    def last(job):
        if kind == "rf":
            return list(_forest(*taught(-1), width, range(*job), best["depth"], seed))
        return list(_boosted(*taught(-1), width, best["trees"], best["depth"], best["rate"]))

    jobs = [(a, min(a + TREES_A_TASK, best["trees"])) for a in range(0, best["trees"], TREES_A_TASK)] if kind == "rf" else [None]
    trees = [t for some in _tasks(spark, jobs, last) for t in some]
    return Trees(kind, trees, width, best["depth"]), means, [float(np.std(s)) for s in scores]
