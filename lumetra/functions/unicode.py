"""Removal of marks by Unicode decomposition.

Latin-1 letters are folded by a table inside the JVM; only rows with other characters reach the Arrow function, all
others go to it as nulls. ``nfd`` removes nonspacing marks (category Mn) after canonical decomposition, ``nfkd`` all
combining characters after compatibility decomposition, which also spells ligatures, full-width and circled forms out.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .python_udfs import by_parts

#: Letters and signs up to U+00FF whose decomposition differs, by form; computed from the character database.
LATIN_1 = [chr(c) for c in range(0x80, 0x100)]


def strip_nfd(text: str) -> str:
    """``text`` decomposed canonically, without nonspacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def strip_nfkd(text: str) -> str:
    """``text`` decomposed by compatibility, without combining characters."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


STRIP = {"nfd": strip_nfd, "nfkd": strip_nfkd}


def without_marks(c: Column, form: str = "nfd") -> Column:
    """Null stays null. ``form`` is nfd or nfkd."""
    strip = STRIP[form]

    @F.arrow_udf("string")
    def beyond(texts: pa.Array) -> pa.Array:
        return by_parts(texts, lambda t: None if t is None else strip(t), pa.string())

    single = {x: strip(x) for x in LATIN_1 if strip(x) != x and len(strip(x)) == 1}
    folded = F.translate(c, "".join(single), "".join(single.values()))
    for x in LATIN_1:  # the few that become several characters, such as fractions
        if len(strip(x)) != 1:
            folded = F.replace(folded, F.lit(x), F.lit(strip(x)))
    rare = c.rlike(r"[^\x00-\xFF]")
    return F.when(rare, beyond(F.when(rare, c))).otherwise(folded)
