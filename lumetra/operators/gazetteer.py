"""Whole-word dictionary matches without comparing every document with every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD

#: Names that are broadcast; a longer list is shuffled.
BROADCAST_NAMES = 100_000
#: A word, or what stands between two.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def _units(text: Column, pairs: bool, words: bool) -> Column:
    """Words of a text, pairs of neighbouring ones with what stands between them, or both, each in the order of the text."""

    def of(p: Column) -> Column:
        first = F.when(F.regexp(F.get(p, 0), F.lit(f"^{WORD}$")), 0).otherwise(1)
        none = F.array().cast("array<string>")
        two = F.transform(F.sequence(first, F.greatest(F.size(p) - 3, first), F.lit(2)), lambda i: F.concat(F.get(p, i), F.get(p, i + 1), F.get(p, i + 2)))
        one = F.transform(F.sequence(first, F.greatest(F.size(p) - 1, first), F.lit(2)), lambda i: F.get(p, i))
        kinds = [F.when(F.size(p) >= first + n, x).otherwise(none) for n, x, on in ((3, two, pairs), (1, one, words)) if on]
        return F.concat(*kinds)

    # the pieces are worked out once
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), of), 1)


def whole_word_matches(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name) for each lower-case name that stands in the text between word boundaries.

    A name's first two words with what stands between them, or its only word, are looked up among the document's by an
    equi-join that carries no text. For names that are no more than that this is the match; only documents that have
    the beginning of a longer name are searched for the whole of it.
    """
    low = names.select(F.lower("name").alias("name"))
    keyed = low.select("name", F.get(_units(F.col("name"), True, True), 0).alias("unit")).where("unit IS NOT NULL")
    # one row: what kinds of names there are
    kinds = keyed.agg(F.count("*"), F.count_if(F.regexp("unit", F.lit(f"^{WORD}$"))), F.count_if(F.col("name") != F.col("unit"))).first()
    few = F.broadcast(keyed) if kinds[0] <= BROADCAST_NAMES else keyed
    units = documents.select("doc_id", F.explode(F.array_distinct(_units(F.lower("text"), kinds[1] < kinds[0], kinds[1] > 0))).alias("unit"))
    found = units.join(few, "unit")
    whole = found.where(F.col("name") == F.col("unit")).select("doc_id", "name")
    if not kinds[2]:
        return whole.distinct()
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), F.col("name"), F.lit(r"\E($|[^\p{L}\p{N}_])"))
    longer = found.where(F.col("name") != F.col("unit")).select("doc_id", "name").distinct()
    searched = documents.select("doc_id", "text").join(longer, "doc_id").where(F.regexp(F.lower("text"), pattern)).select("doc_id", "name")
    return whole.unionByName(searched).distinct()
