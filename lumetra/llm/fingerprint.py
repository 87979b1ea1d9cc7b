"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon keeps the terms whose inverse document frequency ln(N / df) lies in a band; N and df count every
document. The band's upper end bounds the lexicon whatever N is: a term in it stands in at least N / e^high
documents, so there are at most e^high times the mean number of distinct terms a document. Each fingerprint
holds, for each of ``len(RATES)`` rates and ``EACH`` subsets a rate, the hash of the document's sorted
distinct terms that lie in that random subset of the lexicon. The rates reach from a whole band down to a
small part of it, so that short and long texts both have subsets that catch a few of their terms.

The likeness of two fingerprints is the largest, over the rates, of the share of subsets on which they
agree among those that at least one of them fills: subsets without a term say nothing.

Equal texts give equal fingerprints, as a text's fingerprint depends on the text and the lexicon only. A text
without a term of the lexicon takes all its terms in place of it, and a text without terms has the empty
fingerprint; two such fingerprints are fully alike.

The edited text of a document needs the next document by id. Documents are dealt to ranges of ids; the first
of each range also goes to the range before, where it is read but not answered for. Defined results: null
text is empty; rows of one id follow one another by text; a null id comes first; the one after the last is
the first; a single document follows itself.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of ln(N / df): terms in at most 40 and at least 0.2 per cent of all documents.
BAND = (0.9, 6.2)
RATES, EACH = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003), 16
TERM = re.compile(r"[^\W_]+")
#: Partial counts that a task holds before it passes them on.
FLUSH = 400_000


def _terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) over all documents, counted in parts before the shuffle."""

    def run(batches):
        import pyarrow as pa

        counts: dict[str, int] = {}

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                for t in _terms(text or ""):
                    counts[t] = counts.get(t, 0) + 1
                if len(counts) > FLUSH:
                    yield batch_of()
                    counts.clear()
        yield batch_of()

    return documents.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(documents: DataFrame, band: tuple[float, float] = BAND) -> list[str]:
    """The terms of the band; their number is bounded by the band and the mean length, not by N."""
    n = documents.count()
    kept = document_frequencies(documents).where((F.col("df") >= n * float(np.exp(-band[1]))) & (F.col("df") <= n * float(np.exp(-band[0]))) & (F.col("df") > 1))
    return sorted(r[0] for r in kept.select("term").collect())


class IMatch:
    """Fingerprints over one lexicon."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.names = np.array([self._name(t) for t in terms], dtype=np.uint64)
        self.members = self._draw(self.names)

    @staticmethod
    def _name(term: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(term)

    @staticmethod
    def _draw(names: np.ndarray) -> np.ndarray:
        """Terms by subsets: whether a term is in each of the random subsets."""
        out = np.zeros((len(names), len(RATES) * EACH), dtype=bool)
        for k in range(out.shape[1]):
            x = names ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = (x >> np.uint64(11)).astype(np.float64) < RATES[k // EACH] * 2.0**53
        return out

    def __call__(self, text: str) -> np.ndarray:
        """One number a subset, 0 where the document has no term in it."""
        terms = _terms(text)
        if not terms:
            return np.zeros(len(RATES) * EACH, dtype=np.uint32)
        rows = [i for i in map(self.index.get, terms) if i is not None]
        if rows:
            rows.sort()
            names, members = self.names[rows], self.members[rows]
        else:
            names = np.array(sorted(map(self._name, terms)), dtype=np.uint64)
            members = self._draw(names)
        # the terms are distinct, so the sum of well-mixed names is the hash of their sorted list
        mixed = (names ^ (names >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        sums = members.T.astype(np.uint64) @ mixed
        sums = (sums ^ (sums >> np.uint64(32))) & np.uint64(0x7FFFFFFF)
        return np.where(members.any(axis=0), sums.astype(np.uint32) + np.uint32(1), np.uint32(0))


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; see the module's text."""
    a, b = a.reshape(len(RATES), EACH), b.reshape(len(RATES), EACH)
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    if not filled.any():
        return 1.0
    same = ((a == b) & (a > 0)).sum(axis=1)
    # rates at which hardly any subset is filled say little: a missing subset counts as one that differs
    return float((same / np.maximum(filled, EACH // 4)).max()) if not (a == b).all() else 1.0


def _ranges(documents: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, own: rows by range of ids, with each range's follower as its last, not own, row.

    Only the bounds and the first id of each range, ``parts`` numbers each, reach the driver.
    """
    low = F.lit(str(-(2**63) - 1)).cast("decimal(20,0)")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("ord", F.coalesce(F.col("doc_id").cast("decimal(20,0)"), low))
    bounds = sorted(set(documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    array = F.lit([int(b) for b in bounds]).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(array, lambda b: b <= F.col("doc_id"))))
    docs = docs.withColumn("part", part)
    # the follower of a part is the first row of the next part that has rows, of the first part for the last
    firsts = {r["part"]: r["o"] for r in docs.groupBy("part").agg(F.min("ord").alias("o")).collect()}
    present = sorted(firsts)
    before = {p: present[k - 1] for k, p in enumerate(present)}
    follows = F.lit(None).cast("int")
    if present:
        pairs = F.create_map(*[x for p in present for x in (F.lit(p), F.lit(before[p]))])
        starts = F.create_map(*[x for p in present for x in (F.lit(p), F.lit(str(firsts[p])).cast("decimal(20,0)"))])
        follows = F.when(F.col("ord") == F.element_at(starts, F.col("part")), F.element_at(pairs, F.col("part")))
    own = docs.select("doc_id", "text", "ord", "part", F.lit(0).alias("halo"))
    halo = docs.withColumn("to", follows).where("to IS NOT NULL").select("doc_id", "text", "ord", F.col("to").alias("part"), F.lit(1).alias("halo"))
    return own.unionByName(halo)


def fingerprints(documents: DataFrame, band: tuple[float, float] = BAND, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(documents, band))
    parts = parts or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        import hashlib

        import pyarrow as pa

        match, out = IMatch(shared.value), []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def answer(doc, text, own, after, after_own):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            other = match(edited)
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, after_own)))

        def batch_of():
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        part, last, closed = None, None, False
        for batch in batches:
            for doc, text, p, halo in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["part"].to_pylist(), batch["halo"].to_pylist(), strict=True):
                if p != part:
                    part, last, closed = p, None, False
                if closed:
                    continue  # further rows of the follower's id
                own = match(text)
                if last is not None:
                    answer(*last, text, own)
                last, closed = (doc, text, own), bool(halo)
            yield batch_of()
            out.clear()

    dealt = _ranges(documents, parts).repartition(F.col("part")).sortWithinPartitions("part", "halo", "ord", "text").select("doc_id", "text", "part", "halo")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
