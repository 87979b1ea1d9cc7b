"""N-gram Jaccard join with set-relation skipping: components of documents whose shingle sets are alike.

A document's set holds the hashes of its distinct five-word shingles; two documents link when the sets'
Jaccard similarity is at least 80 per cent. Equal sets are one class from the start. The search is exact:

* Overlap-bound prefix. A pair that links shares most of its tokens, so it shares at least l of the
  hash-smallest n - ceil(0.8 n) + l of them. Only these prefixes are shuffled; a set of whose prefix fewer
  than l tokens occur in another prefix has no partner and is left out.
* Rarity. Of the tokens left, ordered by how many sets have them, all but the l - 1 most frequent propose
  partners. Sets joined by a proposing token form candidate families; families are compared within.
* Index-level skipping. A family's index lists are ordered by set size, and each set reads of a list only
  the block of positions whose sizes can reach the threshold. Families over ``CHUNK`` sets are cut by size
  class and hash, and only chunks whose sizes are compatible meet, in tasks of their own.
* Answer-level skipping. A set whose tokens mostly equal those of a set that was answered before takes over
  that set's overlap counts and corrects them by the lists of the tokens in which the two differ.

Tasks give spanning links, not pairs; components over them are found on DataFrames.

Defined results: null text or no words is an empty set that links with nothing; fewer than five words are
one shingle; a null doc_id takes part, and a component's id is the smallest id that is not null (for an
unlinked row its own id); rows that repeat an id keep a row each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialise

WORDS, PERCENT = 5, 80
#: Sets that one task compares with one another.
CHUNK = 4096
#: Texts whose Python objects a task holds at a time.
AT_ONCE = 512
#: Documents that may be named in a broadcast when their texts are read again (16 bytes each).
BROADCAST_ROWS = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Distinct shingle hashes of a text, ascending as signed numbers."""

    def __init__(self, words: int = WORDS, memory: int = 100_000):
        self.words, self.memory, self.known = words, memory, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").translate(LOWER).split()
        if len(self.known) > self.memory:
            self.known = _Words()
        h = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        if not len(h):
            return np.empty(0, np.int64)
        size = min(self.words, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


def _least_overlap(n: np.ndarray | int):
    """ceil of 80 per cent of n: what a set of n tokens shares with any partner at least."""
    return -(-n * PERCENT // 100)


def prefix_size(n: int) -> int:
    return n - _least_overlap(n) + max(1, n // 10)


def _signatures(documents: DataFrame, with_prefix: bool = True) -> DataFrame:
    """doc_id, th (hash of the text), sig (128 bits of the set), n and the hash-smallest tokens."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingle = Shingler()
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            sigs, sizes, prefixes = [], [], []
            for text in batch["body"].to_pylist():
                s = shingle(text)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                prefixes.append(s[: prefix_size(len(s))] if len(s) else s)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "th", "sig", "n", "prefix"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("body"))
    return docs.mapInArrow(run, "doc_id long, th long, sig binary, n long, prefix array<long>")


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, n, tokens for ``wanted`` (sid, sig, rep): each representative's text is read again."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingle = Shingler()
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            out = []
            for sid, sig, text in zip(batch["sid"].to_pylist(), batch["sig"].to_pylist(), batch["body"].to_pylist(), strict=True):
                s = shingle(text)
                if xxhash.xxh3_128_digest(s.tobytes()) == sig:  # a repeated id can name another text
                    out.append((sid, len(s), s))
            ends = np.cumsum([0, *(len(x[2]) for x in out)]).astype(np.int32)
            values = np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["sid", "n", "tokens"])

    wanted = wanted.select("sid", "sig", "rep")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    held = docs.join(few, F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "sig", "body")
    return materialise(held.mapInArrow(run, "sid long, n long, tokens array<long>").dropDuplicates(["sid"]), "full-sets")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def list_blocks(index: np.ndarray, m: int, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``index`` (token code * m + position, ascending) the positions low to high - 1 of each code's list stand."""
    return np.searchsorted(index, codes * m + low), np.searchsorted(index, codes * m + high)


def spanning_links(sets: list[np.ndarray], ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the sets as all pairs at the threshold do: (id, smallest id of its component)."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.lexsort((ids, sizes))
    sets, ids, sizes = [sets[i] for i in order], ids[order], sizes[order]
    tokens = np.concatenate(sets)
    _, code = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    by_token = np.argsort(code, kind="stable")  # each list in order of set size
    lists = owner[by_token]
    index = code[by_token].astype(np.int64) * m + lists
    begin = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.arange(m)
    base, base_codes, base_counts, base_high = -1, None, None, 0

    def counts_of(codes: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each set of the block [low, high) stands in the lists of ``codes``."""
        spans = [lists[a:b] for a, b in zip(*list_blocks(index, m, codes, low, high), strict=True) if a < b]
        return np.bincount(np.concatenate(spans), minlength=m) if spans else np.zeros(m, dtype=np.int64)

    for i in range(m):
        own = np.sort(code[begin[i] : begin[i + 1]])
        # sizes that can reach the threshold lie in one block of positions, from i on
        high = int(np.searchsorted(sizes, sizes[i] * 100 // PERCENT, side="right"))
        if high - i < 2:
            continue
        if base >= 0:
            more, less = np.setdiff1d(own, base_codes, assume_unique=True), np.setdiff1d(base_codes, own, assume_unique=True)
        if base >= 0 and len(more) + len(less) < len(own) // 2:
            if high > base_high:  # the earlier answer ends where its own block did
                base_counts, base_high = base_counts + counts_of(base_codes, base_high, high), high
            counts = base_counts + counts_of(more, i, high) - counts_of(less, i, high)
        else:
            counts = counts_of(own, i, high)
            base, base_codes, base_counts, base_high = i, own, counts, high
        near = np.arange(i + 1, high)
        inter = counts[i + 1 : high]
        near = near[100 * inter >= PERCENT * (sizes[i] + sizes[near] - inter)]
        for j in near:
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([_find(parent, i) for i in range(m)])
    least: dict[int, int] = {}
    for r, x in zip(roots, ids, strict=True):
        least[r] = min(int(x), least.get(r, int(x)))
    return [(int(x), least[r]) for r, x in zip(roots, ids, strict=True) if int(x) != least[r]]


def _links(tasks: DataFrame) -> DataFrame:
    """Spanning links (a, b) of every task; ``tasks`` has task, sid, tokens."""

    def run(batches):
        import pyarrow as pa

        def flush(ids, sets, out):
            out += spanning_links(sets, np.array(ids, dtype=np.int64))

        now, ids, sets = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys, sids, arrays = batch["task"].to_pylist(), batch["sid"].to_pylist(), batch["tokens"]
            flat, ends = arrays.flatten().to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
            ends = ends - ends[0]
            for k, (key, sid) in enumerate(zip(keys, sids, strict=True)):
                if key != now:
                    flush(ids, sets, out)
                    now, ids, sets = key, [], []
                ids.append(sid)
                sets.append(flat[ends[k] : ends[k + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = []
        flush(ids, sets, out)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _tasks(family: DataFrame, chunk: int) -> DataFrame:
    """(task, sid): every family in one task, or large ones as the pairs of their chunks that can link.

    Chunks are a size class (sizes within a factor of 1.25) and a hash; classes that differ by more than one
    never meet.
    """
    family = family.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    total = family.groupBy("family").agg(F.count("*").alias("total"))
    small = family.join(total.where(F.col("total") <= chunk), "family").select(F.xxhash64("family").alias("task"), "sid")
    large = family.join(total.where(F.col("total") > chunk), "family")
    width = large.groupBy("family", "cls").agg(F.ceil(F.count("*") / (chunk // 2)).cast("int").alias("k"))
    own = width.select("family", "cls", "k")
    below = width.select("family", (F.col("cls") + 1).alias("cls"), F.col("k").alias("k_below"))
    above = width.select("family", (F.col("cls") - 1).alias("cls"), F.col("k").alias("k_above"))
    kinds = own.join(below, ["family", "cls"], "left").join(above, ["family", "cls"], "left").na.fill(0, ["k_below", "k_above"])
    put = large.join(kinds, ["family", "cls"]).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    name = lambda c1, i1, c2, i2: F.xxhash64(F.col("family"), c1, i1, c2, i2)
    zero, one = F.lit(0), F.lit(1)
    span = lambda n: F.when(n > 0, F.sequence(zero, F.greatest(n - 1, zero))).otherwise(F.array().cast("array<int>"))
    c, i = F.col("cls"), F.col("i")
    keys = F.concat(
        F.transform(span(F.col("k")), lambda j: name(c, F.least(i, j), c, F.greatest(i, j))),
        F.transform(span(F.col("k_above")), lambda j: name(c, i, c + one, j)),
        F.transform(span(F.col("k_below")), lambda j: name(c - one, j, c, i)),
    )
    return small.unionByName(put.select(F.explode(keys).alias("task"), "sid"))


def _found(documents: DataFrame, chunk: int) -> DataFrame:
    """doc_id, th, n, component_id and front (the id, null last, and th that stand first in the component) for every row."""
    rows = materialise(_signatures(documents), "signatures")
    classes = rows.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("front"), F.first("prefix").alias("prefix"))
    sets = materialise(classes.withColumn("sid", F.monotonically_increasing_id()), "sets")

    tokens = sets.select("sid", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    due = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / 10)).cast("int")
    held = tokens.join(shared, "token").groupBy("sid", "n").agg(F.collect_list(F.struct("df", "token")).alias("own")).where(F.size("own") >= due)
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    # the prefix's unshared tokens come first by rarity; of the shared ones as many propose as are left
    propose = (length - due + 1 - (length - F.size("own"))).cast("int")
    held = held.withColumn("own", F.slice(F.sort_array("own"), 1, F.greatest(propose, F.lit(0)))).where(F.size("own") > 0)
    lists = materialise(held.select("sid", "n", F.explode("own.token").alias("token")), "lists")

    first = lists.groupBy("token").agg(F.min("sid").alias("lead"), F.count("*").alias("df")).where("df > 1")
    star = lists.join(first, "token").where("sid <> lead").select("sid", "lead").distinct()
    families = materialise(connected_components(star).toDF("sid", "family"), "families")
    wanted = sets.select("sid", "sig", "rep", "n").join(families, "sid")
    full = _full_sets(documents, wanted)
    tasks = _tasks(families.join(full.select("sid", "n"), "sid"), chunk)
    links = _links(tasks.join(full.select("sid", "tokens"), "sid"))
    groups = connected_components(links).toDF("sid", "group")

    named = sets.select("sid", "sig", "rep", "front").join(groups, "sid", "left").withColumn("group", F.coalesce("group", "sid"))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"), F.min("front").alias("front"))
    known = named.select("sig", "group").join(least, "group").select("sig", "component_id", "front")
    # the hot classes of copies repeat one sig; few rows a class make the other side small, so skew splits work
    return rows.select("doc_id", "th", "sig", "n").join(known, "sig", "left").drop("sig")


def near_duplicates(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id for every document row."""
    return _found(documents, chunk).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(documents: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id (null ids last, then the hash of the text), and every row without words.

    Of rows that repeat id and text, one stays, the least by all its columns.
    """
    own = _found(documents, CHUNK).where("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("times"), F.first("front").alias("front"))
    first = F.col("doc_id").eqNullSafe(F.col("front.doc_id")) & (F.col("th") == F.col("front.th"))
    named = materialise(own.where(~first | (F.col("times") > 1)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), first.alias("__again")), "near-duplicates")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    left, again = documents.join(named, on, "left_anti"), named.where("__again")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in documents.columns]
    one = documents.join(again, on, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th")).agg(F.min(F.struct(*columns)).alias("__row"))
    return left.unionByName(one.select("__row.*"))
