"""Functions that Spark lacks, over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def by_parts(values: pa.Array, function: Callable, kind: pa.DataType, at_once: int = 256) -> pa.Array:
    """``function`` of each value; no more than ``at_once`` of a batch are Python objects at a time."""
    parts = [pa.array([function(x) for x in values.slice(s, at_once).to_pylist()], kind) for s in range(0, len(values), at_once)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def split_text(text: str, size: int = 600, overlap: int = 100, separators=SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works, overlapping by whole pieces."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else text.split(sep)
    out, held = [], []

    def joined(xs):
        return sep.join(xs).strip()

    def flush():
        if held and joined(held):
            out.append(joined(held))

    for part in parts:
        if len(part) > size:
            flush()
            held.clear()
            out.extend(split_text(part, size, overlap, rest) if rest else [part])
            continue
        if held and len(sep.join([*held, part])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def recursive_chunks(size: int = 600, overlap: int = 100):
    @F.arrow_udf("array<string>")
    def chunks(texts: pa.Array) -> pa.Array:
        return by_parts(texts, lambda t: split_text(t, size, overlap) if t else [], pa.list_(pa.string()))

    return chunks


def first_json_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` block of a text that parses as JSON."""
    for start, c in enumerate(text or ""):
        if c != "{":
            continue
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            ch = text[at]
            if quoted:
                quoted, escaped = ch != '"' or escaped, ch == "\\" and not escaped
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : at + 1])
                        return text[start : at + 1]
                    except ValueError:
                        break
    return None


def lenient_json():
    @F.arrow_udf("string")
    def block(texts: pa.Array) -> pa.Array:
        return by_parts(texts, first_json_object, pa.string())

    return block


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by a common prefix of up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    m, swapped = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_similarity():
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return similarity


# Portuguese suffix classes with the least stem length and the replacement, in order of length.
SUFFIXES = {
    "plural": [("ões", 3, "ão"), ("oes", 3, "ao"), ("ais", 1, "al"), ("eis", 2, "el"), ("ois", 2, "ol"), ("ns", 1, "m"), ("les", 3, "l"), ("res", 3, "r"), ("s", 2, "")],
    "adverb": [("mente", 4, "")],
    "augment": [("zinho", 2, ""), ("zinha", 2, ""), ("inho", 3, ""), ("inha", 3, ""), ("issimo", 3, ""), ("issima", 3, ""), ("zao", 2, ""), ("ao", 3, "")],
    "noun": [("amento", 3, ""), ("imento", 3, ""), ("idade", 4, ""), ("acao", 3, ""), ("icao", 3, ""), ("ador", 3, ""), ("edor", 3, ""), ("ante", 2, ""), ("avel", 2, ""), ("ivel", 3, ""), ("ismo", 3, ""), ("ista", 4, ""), ("oso", 3, ""), ("osa", 3, ""), ("ico", 4, ""), ("ica", 4, ""), ("ncia", 3, ""), ("al", 4, "")],
    "verb": [("ariamos", 2, ""), ("assemos", 2, ""), ("ando", 2, ""), ("endo", 3, ""), ("indo", 3, ""), ("aram", 2, ""), ("eram", 3, ""), ("iram", 3, ""), ("avam", 2, ""), ("ado", 2, ""), ("ido", 3, ""), ("ada", 2, ""), ("ida", 3, ""), ("ava", 2, ""), ("ar", 2, ""), ("er", 2, ""), ("ir", 3, ""), ("ou", 3, ""), ("am", 2, ""), ("em", 2, "")],
    "vowel": [("a", 3, ""), ("e", 3, ""), ("o", 3, "")],
}


def stem(word: str) -> str:
    """Suffix stripping in the published order of steps: plural, adverb, augmentative, noun, else verb, else vowel."""
    if word[:1].isdigit() or len(word) < 3:
        return word

    def strip(w: str, step: str) -> tuple[str, bool]:
        for suffix, least, put in SUFFIXES[step]:
            if w.endswith(suffix) and len(w) - len(suffix) >= least:
                return w[: len(w) - len(suffix)] + put, True
        return w, False

    for step in ("plural", "adverb", "augment"):
        word, _ = strip(word, step)
    word, done = strip(word, "noun")
    if not done:
        word, done = strip(word, "verb")
    return word if done else strip(word, "vowel")[0]


def stemmed():
    """Stems of arrays of tokens: each different token of a batch is stemmed once, and only those are Python objects."""

    @F.arrow_udf("array<string>")
    def stems(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        known = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string())
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, known.take(words.indices), mask=tokens.is_null() if tokens.null_count else None)

    return stems
