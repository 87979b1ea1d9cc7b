"""URL allow and block decisions: longest path rule first, else gradient-boosted trees on lexical features.

Applying both is a chain of JVM expressions without a shuffle. The trees are fitted on the driver from a
bounded list of labelled URLs (``labelled_urls``: at most ``TRAINING_URLS`` generated examples, or the
caller's own) and become nested CASE expressions. Suffix statistics, the smoothed share of blocked URLs under each
last label of a host, come from the same list.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; the trees then
judge the empty host. Repeated rows repeat their result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .text import ascii_lower

#: Bound of the generated training list.
TRAINING_URLS = 6000

# Words that mark hosts of spam, betting, adult and tracking sites, and ordinary site words.
BAD_WORDS = "adult ads adserver banner bet bets betting bonus cam cams casino cheap click crack dating escort free gambling hack jackpot keygen loan loans malware nude pharma phish pills poker popup porn replica scam sex slots spam torrent track tracker tracking viagra warez win winner xxx".split()
GOOD_WORDS = "academy air art blog book books care city club daily data design dev family farm food forum garden green health help history home journal lab learn library life local market media music news north open park photo press review river school science shop south sport store studio team tech times town travel trust water weather web wiki wood work world".split()
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
FEATURES = ["host_length", "path_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "distinct_ratio", "entropy", "params", "bad_words", "longest_label", "suffix_rate", "longest_part", "path_digit_ratio", "vowel_ratio"]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _symbols(text: Column) -> Column:
    return F.split(text, "")


def _feature_columns(url: Column, host: Column, path: Column, rates: dict[str, float]) -> list[Column]:
    """The lexical features as JVM expressions, in the order of FEATURES."""
    n = F.length(host)
    one = F.greatest(n, F.lit(1))
    whole = F.concat(host, path)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-."
    counts = [(n - F.length(F.replace(host, F.lit(c)))) for c in letters]
    entropy = functools.reduce(lambda a, b: a + b, [F.when(c > 0, -(c / one) * F.log2(c / one)).otherwise(0.0) for c in counts])
    present = functools.reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in counts])
    tokens = F.filter(F.split(host, "[^a-z]+"), lambda t: t.isin(*BAD_WORDS))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    labels = F.split(host, r"\.")
    known = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    rate = F.coalesce(F.try_element_at(known, F.element_at(labels, -1)), F.lit(rates[""]))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    return [
        n, F.length(path), F.size(labels), F.length(path) - F.length(F.replace(path, F.lit("/"))), digits(whole) / F.greatest(F.length(whole), F.lit(1)), digits(host) / one,
        n - F.length(F.replace(host, F.lit("-"))), present / one, entropy, F.when(F.instr(url, "?") > 0, F.lit(1) + F.length(url) - F.length(F.replace(url, F.lit("&")))).otherwise(0),
        size(tokens), F.array_max(F.transform(labels, lambda x: F.length(x))), rate, F.array_max(F.transform(F.split(path, "/"), lambda x: F.length(x))),
        digits(path) / F.greatest(F.length(path), F.lit(1)), F.length(F.regexp_replace(host, "[^aeiou]", "")) / one,
    ]


def _parts(url: str) -> tuple[str, str]:
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    return (m[1].translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})), m[2]) if m else ("", "")


def suffix_rates(labelled: list[tuple[str, int]], weight: float = 20.0) -> dict[str, float]:
    """Share of blocked URLs by last label of the host, drawn to the share of all, which stands under ''."""
    total = sum(y for _, y in labelled) / max(len(labelled), 1)
    seen: dict[str, list[int]] = {}
    for u, y in labelled:
        seen.setdefault(_parts(u)[0].rsplit(".", 1)[-1], []).append(y)
    return {"": total} | {k: (sum(v) + weight * total) / (len(v) + weight) for k, v in sorted(seen.items()) if k and len(v) >= 5}


def _feature_row(url: str, rates: dict[str, float]) -> list[float]:
    """The same features in Python, for fitting."""
    host, path = _parts(url)
    n, one, whole = len(host), max(len(host), 1), host + path
    counts = [host.count(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-."]
    tokens = [t for t in re.split("[^a-z]+", host) if t in BAD_WORDS]
    labels = host.split(".")
    digits = lambda s: sum(c in "0123456789" for c in s)
    return [
        n, len(path), len(labels), path.count("/"), digits(whole) / max(len(whole), 1), digits(host) / one, host.count("-"), sum(c > 0 for c in counts) / one,
        -sum(c / one * math.log2(c / one) for c in counts if c), 1 + url.count("&") if "?" in url else 0, len(tokens), max(map(len, labels)),
        rates.get(labels[-1], rates[""]), max(map(len, path.split("/"))), digits(path) / max(len(path), 1), sum(c in "aeiou" for c in host) / one,
    ]


def labelled_urls(n: int = TRAINING_URLS, seed: int = 11) -> list[tuple[str, int]]:
    """Generated labelled URLs: 1 for hosts of marked words, machine-made hosts, hyphen chains and parameter farms.

    Each third URL is a blocked one. Ordinary URLs show one such trait now and then, so that none decides alone.
    """
    r = random.Random(seed)
    syllables = "an be co de el fa ga hi in jo ka le mi no or pa que ra sa ti un ve wi xo ya za th st er on re ou ing tion ble nd".split()
    made = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    junk = lambda a, b: "".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(a, b)))
    ordinary = lambda: "-".join(r.choice([made, made, lambda: r.choice(GOOD_WORDS)])() for _ in range(r.choice([1, 1, 1, 2, 2, 3])))
    parts = lambda a, b: "/" + "/".join(r.choice([made(), r.choice(["en", "de", "fr", "es"]), str(r.randint(1, 60000))]) for _ in range(r.randint(a, b)))
    query = lambda a, b: "?" + "&".join(f"{made(1, 1)}={r.choice([made(), str(r.randint(1, 10**6)), junk(4, 12)])}" for _ in range(r.randint(a, b)))
    common, rare = [".com", ".net", ".org", ".de", ".info", ".io"], [".top", ".xyz", ".click", ".loan", ".win"]
    out = []
    for i in range(n):
        bad = i % 3 == 0
        kind = r.choice(["words", "words", "machine", "chain", "farm"]) if bad else "plain"
        suffix = r.choice(["", ".example", "." + made()]) + r.choice(rare if r.random() < (0.35 if bad else 0.02) else common)
        site, path, tail = ordinary(), parts(1, 4) + r.choice(["", "/", ".html"]) if r.random() < 0.9 else r.choice(["", "/"]), r.choice(["", "", "?page=2&ref=x", "?utm_source=feed", query(1, 3), "#top"])
        if kind == "words":
            words = [r.choice(BAD_WORDS)] + [r.choice([r.choice(BAD_WORDS), r.choice(GOOD_WORDS), made(), r.choice("abcxyz")]) for _ in range(r.randint(1, 2))]
            r.shuffle(words)
            site = r.choice("---.").join(words) + (str(r.randint(1, 99)) if r.random() < 0.1 else "")
        elif kind == "machine":
            site = junk(9, 22)
        elif kind == "chain":
            site = "-".join(made(1, 2) for _ in range(r.randint(5, 9)))
        elif kind == "farm":
            path, tail = parts(4, 9), query(6, 14)
        elif r.random() < 0.06:
            site, tail = r.choice([(site + str(r.randint(1, 9999)), tail), (site, query(4, 6)), ("-".join([site, made(), made()]), tail), (junk(3, 6), tail)])
        out.append((f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'm.', 'blog.', 'cdn.'])}{site}{suffix}{path}{tail}", int(bad)))
    return out


@functools.lru_cache(maxsize=4)
def _default_model() -> UrlModel:
    return fit_urls(labelled_urls())


class UrlModel:
    """Trees over the features, and the suffix statistics that one of the features takes."""

    def __init__(self, trees: boosting.Trees, rates: dict[str, float]):
        self.trees, self.rates = trees, rates

    def raw(self, urls: list[str]) -> np.ndarray:
        return self.trees.raw(np.array([_feature_row(u, self.rates) for u in urls], dtype=float))


def fit_urls(labelled: list[tuple[str, int]]) -> UrlModel:
    rates = suffix_rates(labelled)
    x = np.array([_feature_row(u, rates) for u, _ in labelled], dtype=float)
    return UrlModel(boosting.fit(x, np.array([y for _, y in labelled], dtype=float), rounds=40, depth=4), rates)


def _best_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule (characters of host and path together) as a struct of rule and verdict."""
    chain = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(pages: DataFrame, rules=None, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' log-odds that the URL should be blocked."""
    model = model or _default_model()
    url = F.coalesce(F.col("url"), F.lit(""))
    base = pages.select("page_id", url.alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = dict(zip(FEATURES, _feature_columns(F.col("u"), F.col("host"), F.col("path"), model.rates), strict=True))
    base = base.withColumns({f"f_{k}": v.cast("double") for k, v in named.items()})
    score = model.trees.column([F.col(f"f_{k}") for k in FEATURES])
    base = base.select("page_id", "host", "path", _best_rule(F.col("host"), F.col("path"), RULES if rules is None else rules).alias("r"), score.alias("block_log_odds"))
    return base.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("block_log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "block_log_odds")
