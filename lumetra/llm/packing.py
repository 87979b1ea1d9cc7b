"""Best-fit packing: a configuration linear program over the length histogram.

Documents are tokenised once; each piece (at most ``capacity`` tokens) becomes a small row. Only the
histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. There a configuration program
(which multisets of lengths to use how often, with the fewest sequences) is solved by multiplicative weights
whose pricing step is a knapsack by dynamic programming over token counts; the fractional solution is
rounded and the rest of the histogram is packed by best fit over length classes. The plan, a list of runs "the next n pieces of
length L go to these sequences at this offset", is as long as the number of configurations allows, whatever
the number of documents, and pieces find their places by their rank among the pieces of their length.

Ranks come from counts by (length, split) with ``splits`` splits of each length, so that a length that a
third of all pieces share is not numbered by one task.

Defined results: null text is an empty text, which is the one token of the end mark; ties between pieces of
one length are broken by doc_id, text hash and piece; repeated rows are packed each; an empty table packs to no row.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

CAPACITY, END = 2048, 0
#: Parts of the fractional solution that are tried for rounding.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1, 0.03)
#: Classes up to which the program is solved again for what rounding leaves, and how often.
FEW_CLASSES, AGAIN = 600, 8
#: Documents that a task tokenises at a time, characters of a word that is remembered, and words remembered.
AT_ONCE, WORD_CHARS, MEMORY = 256, 40, 60_000
PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The splitter of the vocabulary's file over lower-cased Latin-1 text, and white space there.
LATIN_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _byte_signs() -> dict[int, str]:
    """Characters that stand for the UTF-8 bytes of a Latin-1 character in byte-level vocabularies.

    Bytes that print stand for themselves; the others take the code points from 256 on, in order.
    """
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    sign = {b: chr(b) if b in printing else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


BYTE_SIGNS = _byte_signs()


class WordTokenizer:
    """Token ids by words, remembered by word, as little-endian 32-bit bytes.

    The tokenizer composes characters, lower-cases, drops white space and merges inside words of its
    splitter only, so the ids of a text are those of its words in order. Latin-1 texts, whose characters are
    composed already, are split here; chunks with other characters or a special token go to it whole.
    """

    def __init__(self, vocabulary: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.known = Tokenizer.from_file(vocabulary), memory, {}

    def _words(self, text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return LATIN_TOKENS.findall(text.lower())
            except UnicodeEncodeError:
                pass
        out = []
        for chunk in SPACES.split(text):
            if chunk and max(chunk) < "\u0100" and "<|" not in chunk:
                out += LATIN_TOKENS.findall(chunk.lower())
            elif chunk:
                out.append(chunk)
        return out

    def ids(self, text: str) -> bytes:
        words = self._words(text)
        known = self.known
        fresh = [w for w in set(words) if w not in known]
        if known and len(known) + len(fresh) > self.memory:
            known = self.known = {}
            fresh = list(set(words))
        merge = self.tokenizer.model.tokenize
        own = {}
        for w in fresh:
            if max(w) < "\u0100" and "<|" not in w:
                ids = [t.id for t in merge(w.translate(BYTE_SIGNS))]
            else:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            (known if len(w) <= WORD_CHARS else own)[w] = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()
        if own:
            return b"".join(own[w] if w in own else known[w] for w in words)
        return b"".join(map(known.__getitem__, words))


def pieces(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, row (text hash), piece, start, length, ids_crc32."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches):
        tokenizer = WordTokenizer(vocabulary)
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            out = []
            for doc, row, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                out += [(doc, row, p, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
            yield _batch(out)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text"))
    return docs.mapInArrow(cut, PIECE_SCHEMA)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    types = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _priced(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The knapsack by dynamic programming: the largest total price, and for each class the best way to fill up around it.

    ``price`` has an entry for each length, -inf where the histogram has none. Returns the value of the best
    configuration, and by length the value and the contents of the best configuration that holds that length.
    """
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        with_it = best[room - 1 :: -1] + price[1 : room + 1]
        size = int(with_it.argmax()) + 1
        if with_it[size - 1] > best[room - 1]:
            best[room], took[room] = with_it[size - 1], size
        else:
            best[room] = best[room - 1]
    lengths = np.nonzero(np.isfinite(price))[0]
    contents = np.zeros((len(lengths), capacity + 1), dtype=np.int32)
    rows = np.arange(len(lengths))
    contents[rows, lengths] = 1
    room = capacity - lengths
    used = np.maximum.accumulate(np.where(took > 0, np.arange(capacity + 1), 0))  # the room at which something was taken
    while True:
        room = used[room]
        open_ = np.nonzero(room > 0)[0]
        if not len(open_):
            break
        size = took[room[open_]]
        contents[open_, size] += 1
        room[open_] -= size
    return float(best[capacity]), price[lengths] + best[capacity - lengths], contents


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and repetitions: start with the longest class left, add the longest that still fits.

    A configuration repeats until it empties one of its classes, so there are few, whatever the counts.
    """
    out, counts = [], counts.copy()
    while counts.any():
        room, own = capacity, {}
        size = int(np.nonzero(counts)[0].max())
        while size > 0:
            free = counts[size] - own.get(size, 0)
            k = int(min(room // size, free))
            if k:
                own[size] = own.get(size, 0) + k
                room -= k * size
            below = np.nonzero(counts[: min(room, size - 1) + 1])[0]
            size = int(below.max()) if len(below) else 0
        times = int(min(counts[s] // k for s, k in own.items()))
        for s, k in own.items():
            counts[s] -= k * times
        out.append((own, times))
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int, rate: float = 0.7, near: float = 0.02) -> tuple[dict[bytes, float], float]:
    """Configurations with their fractional numbers, and a lower bound of the number of sequences.

    The covering program (fewest configurations that hold every class as often as it stands) by multiplicative
    weights: a round prices the classes, the knapsack gives for each class the best configuration that holds it,
    and those within ``near`` of the dearest share the round's sequences in proportion to their tokens. A class
    that the round covers more than once becomes cheaper, one that it covers less dearer. The mean of the rounds
    is the solution; every round's prices, divided by the dearest configuration, are a dual solution.
    """
    lengths = np.nonzero(counts)[0]
    need, tokens = counts[lengths].astype(float), float((counts * np.arange(capacity + 1)).sum())
    log_price, bound = np.log(lengths / capacity), 0.0
    found: dict[bytes, float] = {}
    for t in range(rounds):
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = np.exp(log_price)
        dearest, value, contents = _priced(price, capacity)
        bound = max(bound, float((need * price[lengths]).sum()) / dearest)
        share = np.where(value >= (1 - near) * dearest, need * lengths, 0.0)
        held = contents[:, lengths]
        # tokens / capacity sequences a round, where one that is not full counts for what it holds
        share *= tokens / float((share * (held @ lengths)).sum())
        covered = share @ held / need
        for k in np.nonzero(share)[0]:
            own = contents[k].tobytes()
            found[own] = found.get(own, 0.0) + share[k] / rounds
        log_price -= rate / np.sqrt(1 + t) * np.clip(covered - 1, -1, 3)
    return found, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 60) -> list[tuple[dict[int, int], int]]:
    """Configurations with their repetitions that hold exactly the histogram, from the configuration program."""
    return planned(histogram, capacity, rounds)[0]


def planned(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 60) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """The plan, how many of its sequences the program's configurations give, and the lower bound of all sequences.

    A solution is rounded so that the running total of its configurations is, the most used first, each as often
    as the classes are left. Of the parts ``SHARES`` of it the one is taken that leads to the fewest sequences once
    the rest is packed by best fit, of equal ones the largest. Histograms of up to ``FEW_CLASSES`` lengths, which
    are cheap to price, are solved again for what is left, ``AGAIN`` times at most.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    whole = int(counts[capacity])
    counts[capacity] = 0
    done: list[tuple[dict[int, int], int]] = [({capacity: 1}, whole)] if whole else []
    if not counts.any():
        return done, 0, float(whole)
    total = lambda chosen: sum(t for _, t in chosen)
    rest, chosen, bound, best = counts, [], 0.0, None
    for again in range(AGAIN if np.count_nonzero(counts) <= FEW_CLASSES else 1):
        found, below = fractional(rest, capacity, rounds)
        bound = bound if again else below
        order = sorted(((x, own) for own, x in found.items()), key=lambda c: (-c[0], c[1]))
        tried = [(chosen + more, left, _best_fit(left, capacity)) for more, left in (_rounded(rest, order, part) for part in SHARES)]
        now = min(tried, key=lambda c: (total(c[0]) + total(c[2]), -total(c[0])))
        if best is None or total(now[0]) + total(now[2]) <= total(best[0]) + total(best[2]):
            best = now
        if total(tried[0][0]) == total(chosen) or not tried[0][1].any():
            break
        chosen, rest = tried[0][:2]
    return done + best[0] + best[2], total(best[0]), whole + max(bound, float((counts * np.arange(capacity + 1)).sum()) / capacity)


def _rounded(counts: np.ndarray, order: list[tuple[float, bytes]], part: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """``part`` of a solution in whole numbers, and the classes that are left."""
    rest, chosen, sum_, given = counts.copy(), [], 0.0, 0
    for x, own in order:
        held = np.frombuffer(own, dtype=np.int32)
        sizes = np.nonzero(held)[0]
        sum_ += x * part
        times = min(int(sum_) - given, int((rest[sizes] // held[sizes]).min()))
        if times > 0:
            given += times
            chosen.append(({int(k): int(held[k]) for k in sizes}, times))
            rest[sizes] -= held[sizes] * times
    return chosen, rest


def runs(configurations: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """length, first (rank), n, each (pieces of it in a sequence), sequence, offset: where ranks of a length go."""
    out, used, sequence = [], {}, 0
    for own, times in configurations:
        offset = 0
        for size, k in sorted(own.items(), reverse=True):
            out.append((size, used.get(size, 0), k * times, k, sequence, offset))
            used[size] = used.get(size, 0) + k * times
            offset += size * k
        sequence += times
    return pd.DataFrame(out, columns=["length", "first", "n", "each", "sequence", "at"]).astype("int64")


def pack(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, splits: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = documents.sparkSession
    cut = materialise(pieces(documents, vocabulary, capacity).withColumn("split", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(splits)).cast("int")), "pieces")
    # at most capacity x splits rows, whatever the input
    counted = cut.groupBy("length", "split").count().toPandas().sort_values(["length", "split"])
    if not len(counted):
        return cut.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counted["before"] = counted.groupby("length")["count"].cumsum() - counted["count"]
    table = runs(plan({int(k): int(v) for k, v in counted.groupby("length")["count"].sum().items()}, capacity)).sort_values(["length", "first"])
    before = {(int(a), int(b)): int(c) for a, b, c in counted[["length", "split", "before"]].itertuples(index=False)}
    rows = {int(size): t[["first", "each", "sequence", "at"]].to_numpy() for size, t in table.groupby("length")}
    shared = spark.sparkContext.broadcast((before, rows))

    def place(batches):
        before, rows = shared.value
        for batch in batches:
            rank = np.array([before[k] for k in zip(batch["length"], batch["split"], strict=True)], dtype=np.int64) + batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            lengths = batch["length"].to_numpy()
            for size in np.unique(lengths):
                mine = np.nonzero(lengths == size)[0]
                run = rows[int(size)]
                at = run[np.searchsorted(run[:, 0], rank[mine], side="right") - 1]
                inside = rank[mine] - at[:, 0]
                sequence[mine] = at[:, 2] + inside // at[:, 1]
                offset[mine] = at[:, 3] + inside % at[:, 1] * int(size)
            yield batch.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    from pyspark.sql import Window

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "split").orderBy("doc_id", "row", "piece")).cast("long") - 1)
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
