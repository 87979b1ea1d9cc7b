"""Removal of repeated word passages through a compacted de Bruijn graph of token k-mers.

Nodes are sequences of ``WINDOW`` - 1 words, a window of ``WINDOW`` words is a step from one node to the next, and a
document is a walk. Steps are never listed for the whole corpus: in each window the k-mer of ``ANCHOR`` words with the
smallest name (the leftmost of equal ones) is its anchor, consecutive windows with one anchor form one edge, and the
edge is named by all its words and the anchor's place. Equal windows have equal anchors at equal places, so

* an anchor that only one document has repeats nothing, and its edges leave at the first join;
* an anchor with a single edge is a stretch without branches: all walks through it have the same windows, and all but
  those of the smallest document lose them at once;
* an anchor with several edges is a branch: one walk of each edge, that of its smallest document, is taken apart into
  single windows, which a second join compares.

Edges and windows that follow each other on the same two walks are compacted into spans with the coordinates of their
source; the source's words are digested (SHA-256) at these coordinates, and a span goes only if its own words have the
same digest. Names are 64 bits (anchor and edge, and two for a window); a chance collision would thus be found and could
only keep a passage.

Joins are plain equi-joins of tables, which AQE may split at a hot key; all grouping is by min, combined before it is
shuffled. Matches never cross documents. Defined results: null is a text without words; rows that repeat id and text
are one document that is written as often; rows that repeat an id with other texts have no smaller id than each other
and lose nothing to each other; a null doc_id comes after all others; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, scratch

WINDOW, ANCHOR = 50, 16
#: Words whose names a task holds at a time, but for a single longer text; distinct words whose names a task remembers.
WORDS_AT_ONCE, NAMES = 400_000, 500_000
LAST_ID = 2**63 - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Names(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= NAMES:
            self.clear()
        name = self[word] = xxhash.xxh64_intdigest(word)
        return name


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _M1 + b
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


def _grams(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of ``size`` words, by doubling."""
    reached, out = 1, names
    while reached < size:
        step = min(reached, size - reached)
        out = _pair(out[: max(len(out) - step, 0)], out[step:])
        reached += step
    return out


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value, the leftmost of equal ones, in each run of ``width``."""
    n = max(len(values) - width + 1, 0)
    best, at, reached = values, np.arange(len(values)), 1
    while reached < width:
        step = min(reached, width - reached)
        later = best[step:] < best[: len(best) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        reached += step
    return at[:n]


def _edges(names: np.ndarray, sizes: np.ndarray, window: int, anchor: int):
    """(document, anchor's name, edge's name, first window, windows) of several documents' edges, in their order."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(names) < window:
        return (np.empty(0, np.int64),) * 5
    document = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.nonzero(np.arange(len(names) - window + 1) + window <= ends[document[: len(names) - window + 1]])[0]
    kmers, whole = _grams(names, anchor), _grams(names, window)
    place = _leftmost_minima(kmers, window - anchor + 1)[inside]
    owner = document[inside]
    if not len(inside):
        return (np.empty(0, np.int64),) * 5
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    cut = np.nonzero(new)[0]
    count = np.diff(np.concatenate([cut, [len(inside)]]))
    first, place, owner = inside[cut], place[cut], owner[cut]
    # an edge has fewer than two windows' words, so its first and its last window hold all of them
    edge = _pair(_pair(whole[first], whole[first + count - 1]), (count * 1_000 + place - first).astype(np.uint64))
    return owner, kmers[place].view(np.int64), edge.view(np.int64), first - starts[owner], count


def _texts(batches, named: bool = True):
    """(rows of a batch, their words, the words' names as one array, words a row), a bounded number of words at a time."""
    import pyarrow as pa

    names = _Names()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        at, held, total = 0, [], 0
        for i in range(batch.num_rows):
            held.append((texts[i].as_py() or b"").split())
            total += len(held[-1])
            if total >= WORDS_AT_ONCE or i + 1 == batch.num_rows:
                flat = np.fromiter((names[w] for words in held for w in words), np.uint64, total) if named else None
                yield batch.slice(at, i + 1 - at), held, flat, np.array([len(w) for w in held], np.int64)
                at, held, total = i + 1, [], 0


def _keyed(documents: DataFrame) -> DataFrame:
    """d and th, which name a text, and text; null ids come last."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def _flat(types, columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def graph_edges(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, edge, d, th, at, windows): the edges of all walks."""

    def run(batches):
        import pyarrow as pa

        types = [("anchor", pa.int64()), ("edge", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())]
        for rows, _, flat, sizes in _texts(batches):
            owner, name, edge, first, count = _edges(flat, sizes, window, anchor)
            d, th = (rows.column(c).to_numpy()[owner] for c in ("d", "th"))
            yield _flat(types, [name, edge, d, th, first, count])

    return _keyed(documents).mapInArrow(run, "anchor long, edge long, d long, th long, at int, windows int")


def _single_windows(asked: DataFrame, window: int) -> DataFrame:
    """(w1, w2, d, th, at) of the windows of (d, th, text, runs of (at, windows))."""

    def run(batches):
        import pyarrow as pa

        types = [("w1", pa.int64()), ("w2", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("at", pa.int32())]
        for rows, _, flat, sizes in _texts(batches):
            starts = np.cumsum(sizes) - sizes
            one, two = _grams(flat, window), _grams(_pair(flat, flat), window)
            runs = rows.column("runs")
            ends = runs.offsets.to_numpy()
            each = np.diff(ends)
            values = runs.values.slice(ends[0], ends[-1] - ends[0])
            count = values.field("windows").to_numpy().astype(np.int64)
            owner = np.repeat(np.repeat(np.arange(rows.num_rows), each), count)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(values.field("at").to_numpy().astype(np.int64), count) + inside
            d, th = (rows.column(c).to_numpy()[owner] for c in ("d", "th"))
            yield _flat(types, [one[starts[owner] + at].view(np.int64), two[starts[owner] + at].view(np.int64), d, th, at])

    return asked.mapInArrow(run, "w1 long, w2 long, d long, th long, at int")


def _digest(words: list[bytes], at: int, size: int) -> bytes:
    return hashlib.sha256(b" ".join(words[at : at + size])).digest()


def _digests(asked: DataFrame) -> DataFrame:
    """(d, th, at, size, digest) of the spans of (d, th, text, spans of (at, size))."""

    def run(batches):
        import pyarrow as pa

        for rows, held, _, _ in _texts(batches, named=False):
            out = []
            for d, th, words, spans in zip(rows.column("d").to_pylist(), rows.column("th").to_pylist(), held, rows.column("spans").to_pylist(), strict=True):
                out += [(d, th, s["at"], s["size"], _digest(words, s["at"], s["size"])) for s in spans]
            yield _flat([("d", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())], list(zip(*out, strict=True)) or [[]] * 5)

    return asked.mapInArrow(run, "d long, th long, at int, size int, digest binary")


def repeated_spans(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(d, th, at, size, digest): word spans whose windows all start in a smaller document, with the digest of the source's words."""
    texts = _keyed(documents)
    where = F.struct("d", "th", "at")
    edges = materialise(graph_edges(documents, window, anchor), "graph-edges")
    # 1. anchors of more than one document
    shared = edges.groupBy("anchor").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("anchor")
    edges = materialise(edges.join(materialise(shared, "shared-anchors"), "anchor"), "shared-edges")
    # 2. the smallest walk of each edge, and the anchors at which walks part
    first = materialise(edges.groupBy("anchor", "edge").agg(F.min(where).alias("src")), "first-walks")
    parting = first.groupBy("anchor").agg(F.min("src.d").alias("lo"), F.max("src.d").alias("hi")).where("lo < hi").select("anchor", F.lit(True).alias("parts"))
    first = materialise(first.join(materialise(parting, "partings"), "anchor", "left"), "first-walks-and-partings")
    steps = materialise(edges.join(first, ["anchor", "edge"]).where("d > src.d OR parts").select("d", "th", "at", "windows", "src"), "steps")
    followed = steps.where("d > src.d")
    runs = steps.where("d = src.d").groupBy("d", "th").agg(F.collect_set(F.struct("at", "windows")).alias("runs"))
    # 3. branches window by window
    single = materialise(_single_windows(texts.join(runs, ["d", "th"]), window), "branch-windows")
    least = single.groupBy("w1", "w2").agg(F.min(where).alias("src"), F.max("d").alias("hi")).where("src.d < hi").select("w1", "w2", "src")
    parted = single.join(materialise(least, "first-windows"), ["w1", "w2"]).where("d > src.d").select("d", "th", "at", F.lit(1).alias("windows"), "src")
    # 4. steps that follow each other on the same two walks become one span
    steps = followed.unionByName(parted).select("d", "th", "at", "windows", F.col("src.d").alias("sd"), F.col("src.th").alias("sth"), (F.col("src.at") - F.col("at")).alias("shift"))
    walk = ["d", "th", "sd", "sth", "shift"]
    w = Window.partitionBy(*walk).orderBy("at", "windows")
    upto = F.max(F.col("at") + F.col("windows")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("new", F.when(F.coalesce(F.col("at") > upto, F.lit(True)), 1).otherwise(0)).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = steps.groupBy(*walk, "span").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("windows")).alias("upto"))
    spans = materialise(spans.select("d", "th", "at", (F.col("upto") - F.col("at") + (window - 1)).alias("size"), "sd", "sth", (F.col("at") + F.col("shift")).alias("sat")), "spans")
    # 5. the source's words at these coordinates
    asked = spans.select(F.col("sd").alias("d"), F.col("sth").alias("th"), F.struct(F.col("sat").alias("at"), "size").alias("span")).distinct()
    asked = asked.groupBy("d", "th").agg(F.collect_list("span").alias("spans"))
    sources = materialise(_digests(texts.join(asked, ["d", "th"])).distinct(), "source-digests").select(F.col("d").alias("sd"), F.col("th").alias("sth"), F.col("at").alias("sat"), "size", "digest")
    return spans.join(sources, ["sd", "sth", "sat", "size"]).select("d", "th", "at", "size", "digest")


def substring_dedup(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed and ``kept``, its words that stay, joined by one space."""

    def run(batches):
        import pyarrow as pa

        types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
        for rows, held, _, sizes in _texts(batches, named=False):
            left = []
            for words, spans in zip(held, rows.column("spans").to_pylist(), strict=True):
                stays = np.ones(len(words), bool)
                for s in spans or []:
                    if _digest(words, s["at"], s["size"]) == s["digest"]:
                        stays[s["at"] : s["at"] + s["size"]] = False
                left.append([w for w, x in zip(words, stays.tolist(), strict=True) if x] if spans else words)
            kept = pa.array([b" ".join(x) for x in left], pa.binary()).cast(pa.string())
            ids = [None if null else d for d, null in zip(rows.column("d").to_pylist(), rows.column("unnumbered").to_pylist(), strict=True)]
            yield _flat(types, [ids, sizes, sizes - np.array([len(x) for x in left], np.int64), kept])

    spark = documents.sparkSession
    with scratch(spark) as keep:
        spans = repeated_spans(documents, window, anchor).groupBy("d", "th").agg(F.collect_list(F.struct("at", "size", "digest")).alias("spans"))
        spans = materialise(spans, "spans-of-documents")
        keep.append(spans)
    own = _keyed(documents).withColumn("unnumbered", F.col("d") == LAST_ID)
    return own.join(spans, ["d", "th"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
