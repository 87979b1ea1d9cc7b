"""Substring dedup, ranked search and the filter audit against brute-force versions and their SQL."""

import math
import os
import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumetra.llm import filter_audit, ranked_search, substring_dedup
from lumetra.llm import queries as llm_queries

SCHEMA = "doc_id long, text string, lang string, source string, th long, d long, n long, row long, item long, mask int, part int, spans int"
DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    """(doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", s, 1, 2, 3, 4, 5, 6, 7, 8) for i, t, s in rows], SCHEMA)


HARD = [(1, None, None), (None, "a null id has this text of some few words here", "s"), (2, "", "s"), (3, "one", "s"), (3, "one", "s"), (4, "é" * 3000 + " long " * 2000, "s"), (5, " \t\r\n\x0b\x0c", "")]

# substring dedup


def removed_words(rows, window):
    texts = [(i if i is not None else 2**63 - 1, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, w in texts:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted((i if i is not None else -1, *x) for (i, _, _), x in zip(rows, out, strict=True))


def kept(spark, rows, window, anchor):
    got = substring_dedup.substring_dedup(frame(spark, rows), window, anchor).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in got)


@pytest.mark.parametrize(("window", "anchor", "words"), [(6, 3, 4), (9, 4, 30), (5, 2, 2)])
def test_substrings_match_brute_force(spark, window, anchor, words):
    r = random.Random(window)
    vocabulary = [f"w{i}é" if i % 5 else f"W{i}" for i in range(words)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            part = list(r.choice(passages))
            if r.random() < 0.5:
                part[r.randrange(len(part))] = r.choice(vocabulary)
            w += part[r.randint(0, 2) :] + [r.choice(vocabulary) for _ in range(r.randint(0, 3))]
        rows.append((r.randint(0, 45), r.choice([" ", "\n", " \t "]).join(w), "s"))
    rows += [rows[0], (None, rows[1][1], "s"), (None, rows[1][1], "s")]
    assert kept(spark, rows, window, anchor) == removed_words(rows, window)
    assert any(x[2] for x in removed_words(rows, window))


def test_substrings_of_hard_rows_and_many_copies(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = HARD + [(100 + i, f"u{i} " * (i % 7) + passage + f" t{i}" * (i % 5), "s") for i in range(80)] + [(99, " ".join(passage.split()[:49]), "s")]
    rows += [(300 + i, "same words " * 40, "s") for i in range(30)]
    assert kept(spark, rows, 50, 16) == removed_words(rows, 50)
    assert kept(spark, [], 50, 16) == []


def test_edges_do_not_depend_on_what_stands_around(spark):
    import numpy as np

    names = np.random.default_rng(3).integers(0, 2**63, 200, dtype=np.uint64)
    own = substring_dedup._edges(names, np.array([200]), 50, 16)
    both = substring_dedup._edges(np.concatenate([names[::-1], names]), np.array([200, 200]), 50, 16)
    second = [x[both[0] == 1] for x in both]
    assert all((a == b).all() for a, b in zip(own[1:], second[1:], strict=True)) and own[4].sum() == 151
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert list(substring_dedup._leftmost_minima(values, 3)) == [1, 1, 4, 4, 4]


# ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    terms = [(i, re.findall(TERM, (t or "").translate(UPPER))) for i, t, _ in docs]
    held = [(i, w) for i, w in terms if w]
    n, length, df = len(held), sum(len(w) for _, w in held), {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for at, (i, w) in enumerate(held):
            m = 75 + 25 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in re.findall(TERM, text.translate(UPPER)) if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0, at))
        out += [(item, r, None if null else i, -s) for r, (s, null, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("stored", "broadcast"), [(100, 200_000), (3, 0), (1, 200_000)])
def test_search_matches_brute_force(spark, stored, broadcast):
    r = random.Random(stored)
    words = [f"{c}{i}" for i in range(14) for c in "abéÉ_"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(r.randint(0, 70), r.choice([" ", "-", "_", "\n"]).join(r.choices(words, weights, k=r.randint(0, 40))).title(), "s") for _ in range(90)]
    docs += [(500 + i, "b1 a2 copies of one text", "s") for i in range(12)] + HARD
    items = [(f"i{i}", " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(15)] + [("i0", "a1 a1 A1 b1"), ("dup", "b1 a2"), ("dup", "b1 a2"), ("none", "zzz"), ("null", None), (None, "copies"), ("blank", "_ -")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id string, text string, rank int, score int")
    got = ranked_search.search(frame(spark, docs), asked, k=5, stored=stored, broadcast_terms=broadcast)
    assert sorted([(x.item_id, x.rank, x.doc_id, x.score) for x in got.collect()], key=repr) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([("i", "one two")], "item_id string, text string")
    docs = frame(spark, [(1, "one", "s")])
    assert ranked_search.search(docs.limit(0), asked).collect() == []
    assert ranked_search.search(docs, asked.limit(0)).collect() == []
    # one document: the weight of a term that all hold is floor(1000 ln(4 / 3))
    assert [tuple(x) for x in ranked_search.search(docs, asked).collect()] == [("i", 1, 1, 287 * (10**9 // (1000 + 1200)))]


# filter audit


def audited(docs, labels):
    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({i for i, *x in labels if x[k]} for k in (0, 1))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = word(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in docs)
        fails.append((s or "", i, {k for k, v in f.items() if v}))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {s for s, _, _ in fails}:
            left = [(i, f) for s, i, f in fails if s == part]
            gone = []
            for step, x in enumerate(order, 1):
                hit = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                only = sum(f == {x} for s, _, f in fails if s == part)
                out[part, order, step] = [len(left), len(hit), sum(x in f for _, f in gone), only, sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit)]
                gone += hit
    for (part, order, step), v in out.items():
        v.append(sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return out


def test_audit_matches_brute_force(spark):
    r = random.Random(7)
    plain = [" ".join(r.choice(["alpha", "beta", "GAMMA", "d", "#x", "one", "two", "three"]) + str(r.randint(0, 60)) for _ in range(r.randint(30, 80))) for _ in range(25)]
    docs = [(r.randint(0, 60), r.choice(plain), r.choice(["s", "t", "", None])) for _ in range(70)] + HARD + [(70 + i, "A copy" * 3, "s" if i % 2 else "t") for i in range(9)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, mask int")
    got = filter_audit.audit(frame(spark, docs), marks).collect()
    want = audited(docs, [x for x in labels if x[0] is not None])
    assert {(x["part"], x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == want and len(got) == len(want)
    assert filter_audit.audit(frame(spark, docs).limit(0), marks).collect() == []
    assert filter_audit.mask_cells(frame(spark, docs), marks.limit(0)).agg(F.sum("n"), F.sum("good"), F.sum("toxic")).first()[:] == (len(docs), 0, 0)


# SQL


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(llm_queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(llm_queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
