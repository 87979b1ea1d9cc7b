"""Removal of repeated byte strings: bucket-pointer refinement at sampled suffixes.

A suffix's bucket after its first n bytes is named by a number, and the bucket after 2n bytes by the pair of
its own number and the number of the suffix n bytes later; starting from single bytes and reusing each
round's numbers gives buckets of the strings that are compared. Names are hashes of what they stand for, so
documents on different machines agree on them without a global sort; ``LANES`` of 64 bits tell strings apart.

Only sampled suffixes are shuffled. The initial bucket of a suffix is its first ``GRAM`` bytes; in every
window of ``length`` bytes the start with the smallest bucket number (the leftmost of equal ones) stands for
the window, so equal windows are stood for by equal grams at equal offsets. A sampled suffix therefore owns
a run of window starts, on average one a hundred bytes, and

* a gram that no other sampled suffix has marks none of its windows;
* suffixes whose whole context (all bytes of all owned windows, and the run) equals another's are repeated;
* the others, one of each different context, are refined by blocks of ``BLOCK`` starts: a block whose union
  of windows is repeated is marked, one whose common bytes are not is dropped, the rest is compared window
  by window.

Matches never cross documents. Defined results: null is an empty text; texts under ``length`` bytes lose
nothing; repeated rows are copies of each other like any two documents with one text; a null doc_id is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

LENGTH, GRAM, BLOCK = 400, 200, 10
#: Documents whose Python objects a task holds at a time.
DOCS_AT_ONCE = 1000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_NAMES = [np.random.default_rng(k).integers(1, 2**63, 256, dtype=np.uint64) for k in (71, 72)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a bucket from its own name and that of a later offset."""
    x = (a * _M1) ^ (b + (a >> np.uint64(31)))
    x *= _M2
    return x ^ (x >> np.uint64(29))


class Buckets:
    """Bucket names of all suffixes of a text after ``n`` bytes, each round from the one before."""

    def __init__(self, data: bytes, lane: int):
        self.size = len(data)
        self.rounds = {1: BYTE_NAMES[lane][np.frombuffer(data, dtype=np.uint8)]}

    def after(self, n: int) -> np.ndarray:
        """One name a suffix of at least ``n`` bytes; n is reached by halves."""
        if n not in self.rounds:
            half = (n + 1) // 2
            own = self.after(half)
            self.rounds[n] = _pair(own[: self.size - n + 1], own[n - half : self.size - half + 1])
            if half != GRAM:
                self.rounds.pop(half, None) if half > 1 else None
        return self.rounds[n]

    def spans(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Names of the strings at ``start`` of ``size`` bytes (GRAM to 4 * GRAM) from gram names that cover them."""
        g = self.after(GRAM)
        name = size.astype(np.uint64)
        for i in range(4):
            name = _pair(name, g[np.minimum(start + i * GRAM, start + size - GRAM)])
        return name


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the leftmost of equal ones) in each window of ``width``."""
    n = len(values) - width + 1
    pad = -len(values) % width
    v = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    # leftmost minimum from each block's start and to each block's end
    head = np.minimum.accumulate(v, axis=1)
    fresh = np.concatenate([np.ones((len(v), 1), bool), v[:, 1:] < head[:, :-1]], axis=1)
    place = np.arange(v.size).reshape(v.shape)
    head_at = np.maximum.accumulate(np.where(fresh, place, -1), axis=1).ravel()
    r = v[:, ::-1]
    tail = np.minimum.accumulate(r, axis=1)
    fresh = np.concatenate([np.ones((len(v), 1), bool), r[:, 1:] <= tail[:, :-1]], axis=1)
    back = np.where(fresh, place[:, ::-1], v.size)
    tail_at = np.minimum.accumulate(back, axis=1)[:, ::-1].ravel()
    flat = v.ravel()
    a, b = tail_at[:n], head_at[width - 1 : width - 1 + n]
    return np.where(flat[b] < flat[a], b, a)


def sample(data: bytes, length: int = LENGTH):
    """(first owned start, owned starts, place of the gram) of every sampled suffix, and the bucket names."""
    if len(data) < length:
        return None
    one, two = Buckets(data, 0), Buckets(data, 1)
    at = _minima(one.after(GRAM), length - GRAM + 1)
    cut = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    return cut, np.diff(np.concatenate([cut, [len(at)]])), at[cut], one, two


def _contexts(first, owned, place, one: Buckets, two: Buckets, length: int):
    """gram, offset of the first start before the gram, owned starts, and two names of the context."""
    size = owned + length - 1
    return one.after(GRAM)[place].view(np.int64), (place - first).astype(np.int32), owned.astype(np.int32), one.spans(first, size).view(np.int64), two.spans(first, size).view(np.int64)


def _types(schema: str) -> list[tuple]:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8()}
    return [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]


def _arrow(types: list[tuple], columns: list[np.ndarray] | None):
    import pyarrow as pa

    columns = columns or [np.empty(0, np.int64)] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and body; rows that repeat both are told apart by nothing."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), body.alias("body"))


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """A row for each sampled suffix: doc_id, th, first, owned, off, gram, c1, c2."""

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "th", "first", "owned", "off", "gram", "c1", "c2"]
        for batch in (b.slice(k, DOCS_AT_ONCE) for b in batches for k in range(0, b.num_rows, DOCS_AT_ONCE)):
            ids, hashes, columns, sizes = [], [], [[] for _ in range(6)], []
            for doc, th, body in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["body"].to_pylist(), strict=True):
                found = sample(body, length)
                if found is None:
                    continue
                first, owned, place, one, two = found
                gram, off, n, c1, c2 = _contexts(first, owned, place, one, two, length)
                for store, c in zip(columns, (first.astype(np.int32), n, off, gram, c1, c2), strict=True):
                    store.append(c)
                ids.append(doc)
                hashes.append(th)
                sizes.append(len(first))
            if not ids:
                continue
            repeat = pa.array(np.repeat(np.arange(len(ids)), sizes))
            own = [pa.array(ids, pa.int64()).take(repeat), pa.array(hashes, pa.int64()).take(repeat)]
            yield pa.RecordBatch.from_arrays(own + [pa.array(np.concatenate(c), type=t) for c, t in zip(columns, types[2:], strict=True)], names=names)

    return docs.mapInArrow(run, "doc_id long, th long, first int, owned int, off int, gram long, c1 long, c2 long")


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value from ``low`` to ``high`` of each row."""
    counts = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(low)), counts)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(batch, column: str):
    """(body, field -> array) for each row of a batch with a list of structs, without Python objects of them."""
    lists, bodies = batch[column], batch["body"].to_pylist()
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    ends = ends - ends[0]
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False).astype(np.int64) for f in flat.type}
    for k, body in enumerate(bodies):
        yield body, {n: v[ends[k] : ends[k + 1]] for n, v in fields.items()}


def _named(body: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(Buckets(body, lane).spans(start, size).view(np.int64) for lane in (0, 1))


def _held(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The texts that ``wanted`` (w_id, w_th, a list) asks for, one row each."""
    held = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["w_id"]) & (docs["th"] == wanted["w_th"]))
    return held.dropDuplicates(["doc_id", "th"]).select(column, "body")


def _blocks(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Blocks of the contexts ``wanted`` (doc_id, th, list of suffixes): the refinement's names.

    kind 0: the bytes common to a block's windows; 1: all bytes of a whole block. ``g`` is the block, n1 and
    n2 the names, cid the context.
    """

    def run(batches):
        types = _types("cid long, gram long, kind byte, g int, n1 long, n2 long")
        for batch in (b.slice(k, DOCS_AT_ONCE) for b in batches for k in range(0, b.num_rows, DOCS_AT_ONCE)):
            out = []
            for body, s in _lists(batch, "suffixes"):
                place, low = s["first"] + s["off"], s["off"] - s["owned"] + 1
                row, g = _spread(low // BLOCK, s["off"] // BLOCK)
                whole = (g * BLOCK >= low[row]) & (g * BLOCK + BLOCK - 1 <= s["off"][row])
                kind = np.concatenate([np.zeros(len(g), np.int64), np.ones(int(whole.sum()), np.int64)])
                row, g = np.concatenate([row, row[whole]]), np.concatenate([g, g[whole]])
                n1, n2 = _named(body, place[row] - g * BLOCK - kind * (BLOCK - 1), np.where(kind == 1, length + BLOCK - 1, length - BLOCK + 1))
                out.append((s["cid"][row], s["gram"][row], kind, g, n1, n2))
            yield _arrow(types, [np.concatenate(c) for c in zip(*out, strict=True)] if out else None)

    return _held(docs, wanted, "suffixes").mapInArrow(run, "cid long, gram long, kind byte, g int, n1 long, n2 long")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Names of single windows: cid, gram, o (offset before the gram), n1, n2 for the blocks in ``wanted``."""

    def run(batches):
        types = _types("cid long, gram long, o int, n1 long, n2 long")
        for batch in (b.slice(k, DOCS_AT_ONCE) for b in batches for k in range(0, b.num_rows, DOCS_AT_ONCE)):
            out = []
            for body, s in _lists(batch, "blocks"):
                row, o = _spread(np.maximum(s["off"] - s["owned"] + 1, s["g"] * BLOCK), np.minimum(s["off"], s["g"] * BLOCK + BLOCK - 1))
                n1, n2 = _named(body, (s["first"] + s["off"])[row] - o, np.full(len(o), length))
                out.append((s["cid"][row], s["gram"][row], o, n1, n2))
            yield _arrow(types, [np.concatenate(c) for c in zip(*out, strict=True)] if out else None)

    return _held(docs, wanted, "blocks").mapInArrow(run, "cid long, gram long, o int, n1 long, n2 long")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, start, stop (bytes): runs of bytes covered by repeated strings; runs can overlap."""
    docs = _keyed(documents)
    rows = materialise(_suffixes(docs, length), "suffixes")
    grams = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("c1").alias("a1"), F.max("c1").alias("b1"), F.min("c2").alias("a2"), F.max("c2").alias("b2"), F.min("off").alias("a3"), F.max("off").alias("b3"), F.min("owned").alias("a4"), F.max("owned").alias("b4")).where("n > 1")
    grams = grams.select("gram", ((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("a3") == F.col("b3")) & (F.col("a4") == F.col("b4"))).alias("uniform"))
    held = materialise(rows.join(grams, "gram"), "shared-suffixes")
    whole = lambda df: df.select("doc_id", "th", F.col("first").alias("start"), (F.col("first") + F.col("owned") + (length - 1)).alias("stop"))

    context = ["gram", "off", "owned", "c1", "c2"]
    mixed = held.where("NOT uniform")
    place = F.struct("doc_id", "th", "first")
    classes = mixed.groupBy(*context).agg(F.count("*").alias("n"), F.min(place).alias("at"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "contexts")
    again = mixed.join(classes.where("n > 1").select(*context), context)

    suffix = F.struct("cid", "gram", "off", "owned", F.col("at.first").alias("first"))
    wanted = classes.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th")).agg(F.collect_list(suffix).alias("suffixes"))
    blocks = materialise(_blocks(docs, wanted, length), "blocks")
    name = ["gram", "kind", "g", "n1", "n2"]
    twice = blocks.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").select(*name)
    found = materialise(blocks.join(twice, name), "shared-blocks")
    whole_blocks = found.where("kind = 1").select("cid", "gram", "g", "n1", "n2")
    by_block = whole_blocks.select("cid", (F.col("g") * BLOCK).alias("low"), (F.col("g") * BLOCK + BLOCK - 1).alias("high"))
    # the windows of a repeated block are partners as well, but once for all contexts that share it
    open_blocks = found.where("kind = 0").select("cid", "gram", "g").join(whole_blocks.select("cid", "g"), ["cid", "g"], "left_anti")
    partners = whole_blocks.join(open_blocks.select("gram", "g").distinct(), ["gram", "g"], "left_semi").groupBy("gram", "g", "n1", "n2").agg(F.min("cid").alias("cid"))
    one = F.struct("cid", "gram", "off", "owned", F.col("at.first").alias("first"), "g")
    named = open_blocks.select("cid", "g").unionByName(partners.select("cid", "g")).distinct()
    cores = named.join(classes, "cid").groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th")).agg(F.collect_list(one).alias("blocks"))
    windows = materialise(_windows(docs, cores, length), "windows")
    name = ["gram", "o", "n1", "n2"]
    twice = windows.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").select(*name)
    by_window = windows.join(twice, name).select("cid", F.col("o").alias("low"), F.col("o").alias("high"))
    marks = by_block.unionByName(by_window)
    members = mixed.join(classes.select(*context, "cid"), context).join(marks, "cid")
    gram_at = F.col("first") + F.col("off")
    refined = members.select("doc_id", "th", (gram_at - F.col("high")).alias("start"), (gram_at - F.col("low") + length).alias("stop"))
    return whole(held.where("uniform")).unionByName(whole(again)).unionByName(refined)


def _lengths(lists) -> list:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_pylist()


def remove_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for every document row."""
    docs = _keyed(documents)
    packed = F.col("start").cast("long") * F.lit(2**32) + F.col("stop")
    runs = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(F.sort_array(F.collect_set(packed)).alias("spans"))

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(k, DOCS_AT_ONCE) for b in batches for k in range(0, b.num_rows, DOCS_AT_ONCE)):
            out = []
            flat = batch["spans"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(x or 0 for x in _lengths(batch["spans"]))])
            for k, (doc, body) in enumerate(zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), strict=True)):
                found = flat[ends[k] : ends[k + 1]]
                if not len(found):
                    out.append((doc, len(body), 0, 0, body))
                    continue
                start, stop = found >> 32, np.maximum.accumulate(found & (2**32 - 1))
                fresh = np.concatenate([[True], start[1:] > stop[:-1]])
                first, last = start[fresh], stop[np.concatenate([fresh[1:], [True]])]
                kept = [body[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(body)], strict=True)]
                out.append((doc, len(body), int((last - first).sum()), len(first), b"".join(kept)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    held = docs.join(runs, docs["doc_id"].eqNullSafe(runs["s_id"]) & (docs["th"] == runs["s_th"]), "left").select("doc_id", "body", "spans")
    return held.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept after removing every byte of a repeated string."""
    return remove_spans(documents, repeated_spans(documents, length))
