"""Chunks of texts with their places, and the best chunks of each document for a few fixed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python_udfs import split_text


def chunk_function(size: int = 600, overlap: int = 100, fixed: bool = False):
    """A table function of a text: (chunk, start, end) a row, ``start`` from 0 in code points.

    ``fixed`` cuts every size - overlap characters; otherwise the coarsest separator that works decides, and a chunk's
    place is that of its text after the start of the chunk before. Null and blank texts have no chunk.
    """

    class Chunks:
        def eval(self, text: str):
            if not text or not text.strip():
                return
            if fixed:
                for start in range(0, max(len(text) - overlap, 1), size - overlap):
                    yield text[start : start + size], start, min(start + size, len(text))
                return
            at = 0
            for chunk in split_text(text, size, overlap):
                at = max(text.find(chunk, at), at)
                yield chunk, at, at + len(chunk)
                at += 1

    return F.udtf(Chunks, returnType="chunk string, start int, end int")


def chunked(rows: DataFrame, key: str, text: str, size: int = 600, overlap: int = 100, fixed: bool = False) -> DataFrame:
    """(key, chunk, start, end): a lateral join of the table function."""
    own = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    out = own.lateralJoin(chunk_function(size, overlap, fixed)(F.col("__text").outer()))
    return out.select(F.col("__key").alias(key), "chunk", "start", "end")


def listed(rows: DataFrame, key: str, text: str, size: int = 600, overlap: int = 100) -> DataFrame:
    """(key, chunks): the fixed chunks of each text as one array of (start, chunk); nothing is shuffled. Null and blank texts have no row."""
    t, step = F.col(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - overlap, F.lit(1)) - 1, F.lit(step))
    return rows.where(t.rlike(r"\S")).select(key, F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.substring(t, s + 1, F.lit(size)).alias("chunk"))).alias("chunks"))


def top_chunks(chunks: DataFrame, key: str, questions: DataFrame, k: int = 2) -> DataFrame:
    """``top_listed`` of chunks that are a row each: (key, chunk, start)."""
    return top_listed(chunks.groupBy(key).agg(F.collect_list(F.struct("start", "chunk")).alias("chunks")), key, questions, k)


def top_listed(documents: DataFrame, key: str, questions: DataFrame, k: int = 2, at_once: int = 256) -> DataFrame:
    """(key, question, rank, start, score): each document's k best chunks for each question, by TF-IDF cosine.

    ``documents`` has a row a document, as ``listed`` gives it. idf is counted among the document's own chunks,
    ln((1 + chunks) / (1 + df)) + 1, so a term that all of them share says little; so all that a document's scores need
    stands in its row, and no row of a term is shuffled. ``questions`` (question, text) is a small fixed set; a question's
    terms that the document lacks count with df 0. Equal scores go to the earlier chunk, and chunks without a common term
    score 0. Words go by 64-bit names, ``at_once`` documents at a time.
    """
    import numpy as np
    import pyarrow as pa

    names = lambda c: F.transform(T.word_tokens(c), lambda w: F.xxhash64(w))
    asked = [(r.question, *np.unique(np.array(r.names, dtype="int64"), return_counts=True)) for r in questions.select("question", names(F.col("text")).alias("names")).collect()]
    own = documents.select(F.col(key).alias("key"), F.transform("chunks", lambda c: c["start"]).alias("starts"), F.transform("chunks", lambda c: names(c["chunk"])).alias("names"))

    def scores(words, sizes):
        """A row a question of each chunk's score; ``words`` are those of all chunks, ``sizes`` how many each has."""
        n, place = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        terms, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(place * max(len(terms), 1) + term, return_counts=True)
        place, term = pair // max(len(terms), 1), pair % max(len(terms), 1)
        df = np.bincount(term, minlength=len(terms))
        w = tf * (np.log((1.0 + n) / (1.0 + df[term])) + 1.0)
        norm = np.sqrt(np.bincount(place, w * w, minlength=n))
        for _, theirs, counts in asked:
            at = np.minimum(np.searchsorted(terms, theirs), max(len(terms) - 1, 0))
            known = terms[at] == theirs if len(terms) else np.zeros(len(theirs), bool)
            wq = counts * (np.log((1.0 + n) / (1.0 + np.where(known, df[at] if len(df) else 0, 0))) + 1.0)
            of_term = np.zeros(len(terms))
            of_term[at[known]] = wq[known]
            dot, length = np.bincount(place, w * of_term[term], minlength=n), np.sqrt((wq * wq).sum())
            yield np.divide(dot, norm * length, out=np.zeros(n), where=dot > 0)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, at_once):
                out = [[], [], []]
                part = batch.slice(s, at_once)
                for i in range(part.num_rows):
                    chunks = part["names"][i].values
                    sizes = np.diff(chunks.offsets.to_numpy())
                    for (question, _, _), x in zip(asked, scores(chunks.flatten().to_numpy(), sizes), strict=True):
                        for held, value in zip(out, (i, question, x), strict=True):
                            held.append(value)
                rows = pa.array(out[0], pa.int32())
                yield pa.RecordBatch.from_arrays([part["key"].take(rows), pa.array(out[1], kind), part["starts"].take(rows), pa.array(out[2], pa.list_(pa.float64()))], names=["key", "question", "starts", "scores"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(questions.schema["question"].dataType)
    schema = f"key {own.schema['key'].dataType.simpleString()}, question {questions.schema['question'].dataType.simpleString()}, starts array<int>, scores array<double>"
    each = F.zip_with("starts", "scores", lambda at, x: F.struct((-F.round(x, 6)).alias("score"), at.alias("start")))
    best = own.mapInArrow(run, schema).select("key", "question", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("at", "x"))
    return best.select(F.col("key").alias(key), "question", (F.col("at") + 1).alias("rank"), F.col("x.start").alias("start"), (-F.col("x.score")).alias("score"))
