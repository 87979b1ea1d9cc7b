"""Brute-force versions, round trips and hard cases of the training-data operators, all on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetra.llm import chat_format, components, decontaminate, fingerprint, html_extract, jaccard_join, line_dedup, packing, page_templates, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, pos int, key string, n long, part int"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "k", 2, 3) for i, t in rows], SCHEMA)


HARD = [(1, None), (None, "a null id has this text of some few words here"), (2, ""), (3, "one"), (3, "one"), (4, "é" * 3000 + " long " * 2000)]


def texts(seed, n=40, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(150)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, words))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        ws = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in ws)))
    return rows


# line dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_left(rows, k, least):
    places = sorted((i, n, x.strip(" ")) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x.strip(" ")) >= least)
    first = {}
    for i, n, x in places:
        first.setdefault(x, (i, n))
    gone = {x for x in first if any(first[y] < first[x] and abs(len(x) - len(y)) <= k and edit(x, y) <= k for y in first if y != x)}
    keep = lambda i, n, x: len(x.strip(" ")) < least or (first[x.strip(" ")] == (i, n) and x.strip(" ") not in gone)
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if keep(i, n, x)) for i, t in rows}


@pytest.mark.parametrize(("k", "least"), [(1, 6), (2, 12)])
def test_line_dedup_matches_brute_force(spark, k, least):
    r = random.Random(k)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randint(3, 30))) for _ in range(25)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = list(r.choice(pool))
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(["", "z", "é", "ab"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.dedup_lines(frame(spark, rows), max_edits=k, min_chars=least)
    assert {x.doc_id: x.text for x in got.collect()} == lines_left(rows, k, least)


def test_relative_links_match_brute_force(spark):
    r = random.Random(21)
    pool = ["x" + "".join(r.choice("abcé ") for _ in range(n - 2)) + "x" for n in (10, 15, 19, 22, 40, 60, 89, 95, 130, 300, 700)]
    lines = set(pool)
    for _ in range(160):
        x = list(r.choice(pool))
        for _ in range(r.randint(0, len(x) // 8 + 1)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randint(0, 1)] = r.choice(["", "z", "é"])
        lines.add("".join(x).strip(" "))
    lines = sorted(x for x in lines if x)
    want = {(a, b) for a in lines for b in lines if a < b and (k := max(len(a), len(b)) // 10) and abs(len(a) - len(b)) <= k and edit(a, b) <= k}
    rows = frame(spark, list(enumerate(lines)))
    texts = line_dedup.distinct_lines(rows, 1)
    name = {x.lid: x.line for x in texts.collect()}
    assert {tuple(sorted((name[x.a], name[x.b]))) for x in line_dedup.edit_links(texts, None).collect()} == want
    assert sum(edit(a, b) > 2 for a, b in want) > 50


def word_lines(seed=31, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    common = [word() for _ in range(12)]
    pool = [[r.choice(common) if r.random() < 0.3 else word() for _ in range(k)] for k in (7, 8, 9, 12, 13, 14, 15, 20, 21, 22, 27, 28, 35, 49, 70, 120, 260)]
    passage = [word() for _ in range(20)]
    lines = set()
    for _ in range(n):
        x = list(r.choice(pool))
        for _ in range(r.choice([0, 1, 1, 2, 3, len(x) // 8, len(x) // 7 + 1])):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randint(0, 1)] = r.choice([[], [word()], [r.choice(common)]])
        if r.random() < 0.1:
            at = r.randrange(len(x) + 1)
            x[at:at] = passage
        lines.add(r.choice([" ", ", ", " - "]).join(w.upper() if r.random() < 0.05 else w for w in x))
    lines |= {"ab " * 40 + x for x in ("q", "r q", "s t u v", "ab")} | {"早上好今天我们去公园散步吧", "早上好今天我们去公園散步吧", "早上坏昨天他们去学校读书吧", "x" * 50 + " y", "x" * 49 + "z y"}
    return sorted(lines)


def test_lines_with_an_earlier_near_copy_match_brute_force(spark):
    lines = word_lines()
    words = lambda t: re.findall(r"[一-龥]|[^\x00-\x2F\x3A-\x60\x7B-\x7F一-龥]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    own = [words(x) for x in lines]

    def linked(a, b):
        m = max(len(own[a]), len(own[b]))
        if m < line_dedup.FEW_WORDS:
            k = max(len(lines[a]), len(lines[b])) // 10
            return k > 0 and abs(len(lines[a]) - len(lines[b])) <= k and edit(lines[a], lines[b]) <= k
        k = max(m // 7 - 1, 1)
        return abs(len(own[a]) - len(own[b])) <= k and edit(own[a], own[b]) <= k

    pairs = {(lines[a], lines[b]) for a in range(len(lines)) for b in range(a + 1, len(lines)) if linked(a, b)}
    texts = line_dedup.distinct_lines(frame(spark, list(enumerate(lines))), 1)
    name = {x.lid: x.line for x in texts.collect()}
    by_words = {p for p in pairs if max(len(words(x)) for x in p) >= line_dedup.FEW_WORDS}
    assert {tuple(sorted((name[x.a], name[x.b]))) for x in line_dedup.word_links(texts).collect()} == by_words
    assert len(by_words) > 100 and len(pairs) > len(by_words)
    assert {name[x.lid] for x in line_dedup.near_earlier(texts).collect()} == {b for _, b in pairs}


def test_words_are_listed_once_and_bounds_are_judged_in_the_join(spark):
    passage, own = [f"p{i}" for i in range(20)], lambda c, n: [f"{c}{i}" for i in range(n)]
    lines = [passage + own("a", 20), own("b", 5) + passage + own("c", 15), passage + own("d", 21), own("e", 1) + passage + own("f", 19), ["same"] * 60, ["same"] * 61]
    texts = line_dedup.distinct_lines(frame(spark, list(enumerate(" ".join(x) for x in lines))), 1)
    name = {x.lid: [" ".join(y) for y in lines].index(x.line) for x in texts.collect()}
    found = line_dedup.proposed(texts)
    pairs = [tuple(sorted((name[x.lid], name[x.other]))) for x in found.collect()]
    # 5 places apart are over the 4 edits of 40 words, and 4 places too: what moved has to move back
    assert set(pairs) == {(0, 2), (0, 3), (2, 3), (4, 5)} and pairs.count((4, 5)) == 1
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_hard_rows(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [*HARD, (7, long), (8, long.replace("word5 ", "other ")), (9, "\n".join(["x"] * 4000)), (10, "a\n\n \nb\na"), (10, "a\nc")]
    df = frame(spark, rows).withColumn("n_lines", F.lit("own")).withColumn("__marks", F.lit(1)).withColumn("__lines", F.lit(1))
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.text) for x in got if x.doc_id in (7, 8)} == {(7, long), (8, "")}
    assert sorted(x.text for x in got if x.doc_id == 3) == ["one", "one"] and [x.n_removed for x in got if x.doc_id == 9] == [3999]
    assert sorted(x.text for x in got if x.doc_id == 10) == ["a\n\n \nb", "a\nc"] and [x.text for x in got if x.doc_id == 1] == [""]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_copy_with_one_word_changed_goes(spark):
    line = "the quick brown fox jumps over the lazy dog while nobody in the village is watching it run away today"
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, [(1, line), (2, line.replace("quick", "small"))])).collect()}
    assert got == {1: line, 2: ""}


def test_lines_that_say_different_things_stay(spark):
    pairs = [
        ("Invoice number 1001 was paid in full today", "Invoice number 2002 was paid in full today"), ("The total for the year 2019 was twelve", "The total for the year 2020 was twelve"),
        ("Patient is allergic to penicillin and to nuts", "Patient is not allergic to penicillin and to nuts"), ("the two parties did sign the long contract here", "the two parties didn't sign the long contract here"),
        ("o prefeito assinou o contrato da obra ontem aqui", "o prefeito não assinou o contrato da obra ontem aqui"), ("room 12 a", "room 13 a"),
    ]
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows)).collect()} == dict(rows)
    same = [(1, "Invoice number 1001 was paid in full today"), (2, "Invoice number 1001 was settled in full today"), (3, "It is not allowed to park on the grass here"), (4, "It is not allowed to park on the lawn here")]
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, same)).collect()} == {1: same[0][1], 2: "", 3: same[2][1], 4: ""}


def test_repeats_of_short_lines_go(spark):
    rows = [(1, "Menu\n\n x \nread more"), (2, "Menu\n\nx\nread on"), (3, "read more\nread more!")]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: ("Menu\n\n x \nread more", 0), 2: ("\nread on", 2), 3: ("", 2)}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_banded_distance(spark, k):
    r = random.Random(k)
    rows = []
    for _ in range(120):
        a = "".join(r.choice("abé") for _ in range(r.randint(1, 20)))
        b = list(a)
        for _ in range(r.randint(0, k + 2)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "c"])
        if abs(len(a) - len(b)) <= k and b:
            rows.append((a, "".join(b), edit(a, b)))
    for x in spark.createDataFrame(rows, "a string, b string, d int").withColumn("e", line_dedup.banded_distance(F.col("a"), F.col("b"), k)).collect():
        assert x.e == x.d if x.d <= k else x.e > k


# decontamination


def hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in rows:
        ws, hit, found = words(t), set(), set()
        for item, x in items:
            xs = words(x)
            size = min(len(xs), window)
            for s in range(len(xs) - size + 1 if size else 0):
                for at in range(len(ws) - size + 1):
                    if ws[at : at + size] == xs[s : s + size]:
                        hit |= set(range(at, at + size))
                        found.add(str(item))
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark):
    rows = texts(5)
    items = [(k, " ".join(t.split()[2:16])) for k, t in rows[:6]] + [(50, "abc dé"), (51, rows[3][1].split()[0].upper()), (52, None), (53, "")] + [(54, rows[9][1].replace("é", "É"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows + HARD), bench)
    assert sorted([(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in got.collect()], key=str) == hits(rows + HARD, items)
    left = {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()}
    assert left == {x[0] for x in hits(rows, items) if not x[2]}
    assert decontaminate.contamination(frame(spark, rows[:3]), bench.limit(0)).where("contaminated").count() == 0


# HTML


def test_html_extraction_on_unseen_layouts(spark):
    model, right = html_extract.trained(), 0
    pages = list(html_extract.training_pages(150, seed=1234))
    for page in pages:
        _, blocks = html_extract.parse(page)
        want = "\n".join(t.replace("\ue000", "") for _, t in blocks if "\ue000" in t)
        right += html_extract.extract([page.replace("\ue000", "")], model)[0] == want
    assert right >= 0.95 * len(pages)


def word_f1(want, got):
    a, b = collections.Counter(want.split()), collections.Counter(got.split())
    return 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1) if a or b else 1.0


def test_html_extraction_on_templates_held_out():
    known = tuple(f for f in page_templates.FAMILIES if f not in page_templates.HELD_OUT)
    model, scores = html_extract.trained(300, 450, known), {}
    for name in page_templates.FAMILIES:
        for page in page_templates.pages(30, 77, (name,)):
            _, blocks = html_extract.parse(page)
            want = "\n".join(t.replace("\ue000", "").strip() for _, t in blocks if "\ue000" in t)
            scores.setdefault(name, []).append(word_f1(want, html_extract.extract([page.replace("\ue000", "")], model)[0]))
    means = {k: float(np.mean(v)) for k, v in scores.items()}
    assert all(means[f] > 0.8 for f in page_templates.HELD_OUT) and np.mean([means[f] for f in page_templates.HELD_OUT]) > 0.9, means
    assert all(means[f] > 0.95 for f in known), means


def test_pages_without_frames_keep_every_block():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 8)))
    for n in (2, 12):
        paragraphs = [" ".join(word() for _ in range(24)).capitalize() + "." for _ in range(n)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        menu = "<ul>" + "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(6)) + "</ul>"
        made = [f"<body>{body}</body>", f"<div>{body}</div>", f"<section>{body}</section>", f"<body><nav>{menu}</nav><div>{body}</div><footer>&copy; {word()}</footer></body>", f"<body><div id=m>{menu}</div><div id=c>{body}</div></body>"]
        made += [f'<article class="featured comments-open">{body}</article>', f'<div class="post has-sidebar with-comments">{body}</div>']
        for page, text in zip(made, html_extract.extract(made, html_extract.trained()), strict=True):
            assert text == "\n".join(paragraphs), page[:60]


def test_html_inline_controls_and_unmatched_ends():
    import time

    read = lambda page: [t for _, t in html_extract.parse(page)[1]]
    assert read("<p>press <button>Go</button> now, and the sum is <math><mi>x</mi></math> here.</p><button>Share</button><p>b</p>") == ["press Go now, and the sum is x here.", "b"]
    assert read("<p>a</p><select><option>no</option></select><div>c <a>d<p>e</a> f</div>g") == ["a", "c d", "e f", "g"]
    for page in ("<b>" * 150_000 + "</i>" * 150_000, "<a>" * 70_000 + "<p>x</a>" * 70_000, "<p>x" + "</q>" * 250_000, "<table>" * 3_000 + "<td>x</p>" * 30_000):
        began = time.perf_counter()
        html_extract.parse(page)
        assert time.perf_counter() - began < 6, page[:20]


def test_html_of_repeated_rows_and_other_columns(spark):
    page = "<article><h1>A title</h1>" + "<p>Some words of a paragraph stand here, and more of them.</p>" * 3 + "</article>"
    rows = [(1, "u", page, "t", 5)] * 2 + [(None, None, page, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 3 and {r.text.split("\n")[0] for r in got} == {"A title"} and {r.n_chars for r in got} == {len(got[0].text)}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_reader_and_hard_cases(spark):
    page = "<body><nav><a href=/>Menu</a></nav><!-- c --><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five</p><script>x<p></script></article><footer>f</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<!-- open"), (6, "u", "<p" + " x" * 5000)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\none two three four\nfive"
    assert [got[i] for i in (2, 3, 5, 6)] == ["", "", "", ""]


def test_html_quotes_and_long_broken_pages():
    import time

    def read(page):
        return [t for _, t in html_extract.parse(page)[1]]

    assert read("<article><p class=a'b>It is text. It's more.</p><p title='a > b' id=\"x>y\">second</p></article>") == ["It is text. It's more.", "second"]
    assert read("<p>one</p><!-- open <p>two") == ["one"] and read("<p>a < b</p>") == ["a < b"] and read("<p>x</p><a href='y") == ["x"]
    for page in ("<p>x</p>" + "<a " * 300_000, "<div>t" * 20_000, "<div>t" * 20_000 + "</div>" * 20_000, "<p>a" * 50_000, "<p>x</p>" + "<!-- " * 50_000):
        began = time.perf_counter()
        nodes, _ = html_extract.parse(page)
        html_extract.features(nodes)
        assert time.perf_counter() - began < 6, page[:20]


# packing


def check_packed(rows, capacity):
    places = {}
    for x in rows:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_is_gapless_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = texts(8, 60) + [(100, "it's 12² <|endoftext|> “quoted” ΑΣ — naïve café\u00a0x\x1cy"), (101, "word " * 5000), *HARD]
    got = packing.pack(frame(spark, rows), capacity=256).collect()
    n = check_packed(got, 256)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    own = lambda s, i: zlib.crc32(np.array(s[i : i + 256], "<u4").tobytes())
    want = sorted((str(i), p, len(s[p * 256 : p * 256 + 256]), own(s, p * 256)) for i, all_ in ids.items() for s in all_ for p in range(-(-len(s) // 256)))
    assert sorted((str(x.doc_id), x.piece, x.length, x.ids_crc32) for x in got) == want
    assert n <= 1.05 * -(-sum(x.length for x in got) // 256) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_plan_holds_the_histogram():
    r = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(r.permutation(np.arange(1, 100))[:40], r.integers(1, 60, 40), strict=True)} | {100: 5}
    used = {}
    for own, times in packing.plan(histogram, 100):
        assert sum(s * k for s, k in own.items()) <= 100
        for s, k in own.items():
            used[s] = used.get(s, 0) + k * times
    assert used == histogram


def test_packing_plan_comes_from_the_program():
    r = np.random.default_rng(2)
    lengths = {"middling": r.normal(500, 60, 30000), "halves": r.uniform(560, 760, 20000), "mixed": r.lognormal(5.5, 1, 60000)}
    plans = {}
    for name, x in lengths.items():
        sizes, times = np.unique(np.clip(x.astype(int), 1, 2048), return_counts=True)
        histogram = dict(zip(sizes.tolist(), times.tolist(), strict=True))
        configurations, program, bound = packing.planned(histogram)
        used = {}
        for own, n in configurations:
            assert sum(s * k for s, k in own.items()) <= 2048
            for s, k in own.items():
                used[s] = used.get(s, 0) + k * n
        assert used == histogram
        counts = np.zeros(2049, dtype=np.int64)
        counts[sizes] = times
        plans[name] = sum(n for _, n in configurations), program, bound, sum(n for _, n in packing._best_fit(counts, 2048))
        assert plans[name][2] <= plans[name][0] and program > 0
    assert plans["middling"][0] <= 1.01 * plans["middling"][2] < 0.97 * plans["middling"][3]  # best fit alone is 5 per cent over
    assert plans["halves"][0] < plans["halves"][3] and plans["mixed"][0] <= 1.001 * plans["mixed"][2]
    best, value, contents = packing._priced(np.array([-np.inf, -np.inf, -np.inf, 2.0, 3.0, -np.inf, -np.inf, -np.inf]), 7)
    assert best == 5.0 and list(value) == [5.0, 5.0] and contents[0].tolist() == [0, 0, 0, 1, 1, 0, 0, 0]


# URLs


def test_url_rules_and_trees(spark):
    urls = ["https://a.EXAMPLE.com/en/7x?y", "http://b.com/en/", "http://x.net/de/1", "http://x.example.net/de/8", "http://xorg/es/", "nourl", None, "http://example.org/es/", "http://casino-win.example.org/en/1", "http://garden-club.example.org/en/1", "a://b://c/d", "http://EXAMPLE.net?x"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (0, 1, 2, 3, 7)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert (got[5].host, got[5].path, got[5].rule) == ("", "", None) == (got[6].host, got[6].path, got[6].rule)
    assert got[8].verdict == "block" and got[9].verdict == "allow"
    assert (got[10].host, got[10].path) == ("b:", "//c/d") and got[11].host == "example.net"


def test_url_column_and_rows_agree_and_generalise(spark):
    held = url_filter.labelled_urls(600, seed=77)
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    raw = url_filter._default_model().raw([u for u, _ in held])
    got = {r.page_id: r.block_log_odds for r in url_filter.judge_urls(df, rules=[]).collect()}
    assert all(abs(got[k] - raw[k]) < 1e-6 for k in got)
    assert np.mean([(got[k] > 0) == bool(y) for k, (_, y) in enumerate(held)]) > 0.95


def test_url_trees_need_several_features():
    model, held = url_filter._default_model(), url_filter.labelled_urls(1500, seed=78)
    x, y = np.array([url_filter._feature_row(u, model.rates) for u, _ in held], dtype=float), np.array([y for _, y in held], dtype=bool)
    right, r = np.mean((model.trees.raw(x) > 0) == y), np.random.default_rng(3)
    lost = {}
    for f, name in enumerate(url_filter.FEATURES):
        mixed = x.copy()
        mixed[:, f] = r.permutation(mixed[:, f])
        lost[name] = right - np.mean((model.trees.raw(mixed) > 0) == y)
    assert right > 0.95 and sum(v > 0.003 for v in lost.values()) >= 4 and lost["params"] > 0.003, lost
    assert model.rates["top"] > 0.7 > 0.4 > model.rates["com"] and model.rates[""] == pytest.approx(1 / 3, abs=0.01)


def test_urls_of_hard_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 5), (2, "x" * 20000, 5), (3, "http://" + "a." * 5000 + "com/" + "b/" * 5000, 5)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int"))
    assert got.count() == 5 and {r.verdict for r in got.collect()} <= {"allow", "block"}
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0


# chats


def test_chats_round_trip(spark):
    turns = [(1, 0, "system", "s\\"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>\n<\\|"), (1, 3, "user", "q"), (1, 4, "assistant", ""), (1, 5, "user", "after"), (2, 0, "user", "no reply"), (None, 0, None, "x"), (3, 0, "ro\nle", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(chat_format.PROBE)
    made = sorted(chat_format.format_chats(df).collect(), key=lambda r: r.example)
    assert len(made) == 2 and chat_format.read_back(made[1].formatted)[-1] == ("assistant", "") and made[0].formatted[made[0].loss_start : made[0].loss_end] == chat_format.escape("a<|im_end|>\n<\\|")


# suffixes


def bytes_left(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen, cover = {}, [np.zeros(len(b), bool) for _, b in data]
    for k, (_, b) in enumerate(data):
        for at in range(len(b) - length + 1):
            first = seen.setdefault(b[at : at + length], (k, at))
            if first != (k, at):
                cover[k][at : at + length] = True
                cover[first[0]][first[1] : first[1] + length] = True
    return sorted(((i, len(b), int(c.sum()), np.frombuffer(b, np.uint8)[~c].tobytes()) for (i, b), c in zip(data, cover, strict=True)), key=str)


def test_suffix_dedup_matches_brute_force(spark):
    r = random.Random(6)
    passage = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(380, 900))) for _ in range(6)]
    rows = [(100, "ab" * 600), (101, "ab" * 450 + "c"), (102, "x" * 1500), *HARD]
    for i in range(40):
        t = "".join(r.choice(["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 300))), (p := r.choice(passage))[r.randint(0, 60) : len(p) - r.randint(0, 60)]]) for _ in range(r.randint(1, 5)))
        if r.random() < 0.3 and t:
            at = r.randrange(len(t))
            t = t[:at] + "#" + t[at + 1 :]
        rows.append((i, t))
    got = suffix_dedup.suffix_dedup(frame(spark, rows))
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept)) for x in got.collect()), key=str) == bytes_left(rows, 400)


# fingerprints


def test_fingerprints(spark):
    rows = texts(9, 50) + [(100, "same text here"), (101, "same text here"), (102, None), (103, ""), (104, "?!")]
    got = {x.doc_id: x for x in fingerprint.fingerprints(frame(spark, rows), parts=5).collect()}
    assert len(got) == len(rows)
    assert got[100].fingerprint == got[101].fingerprint and got[100].near_next == 1.0
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprint.fingerprints(frame(spark, [(7, "alone")])).count() == 1
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    assert fingerprint.fingerprints(frame(spark, HARD)).count() == len(HARD)


# toxicity


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(3, 6)))
    rows = [(i, " ".join([word() for _ in range(30)] + ([r.choice(["zzidiot", "qqscum", "xxtrash"])] if i % 6 == 0 else []))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900) if i % 5 < 4], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows + HARD[:3]), labels).collect()
    held = [x for x in got if x.doc_id is not None and x.doc_id < 900 and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    assert np.mean([x.predicted == int(x.doc_id % 6 == 0) for x in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in got) and len(got) == len(rows) + 3
    assert all(x.score == 0 for x in toxicity.toxicity(frame(spark, rows[:5]), labels.limit(0)).collect())


def test_toxicity_training_brings_telling_features_only(spark):
    """The driver held all features of the 10,000 training rows; it stopped the pipeline over its memory."""
    r = np.random.default_rng(3)
    ids = [np.unique(np.append(r.integers(0, toxicity.SPACE, 200), [7, 9] if i % 4 == 0 else [9])).astype(np.int32) for i in range(200)]
    rows = toxicity._telling_rows(spark.createDataFrame([(int(i % 4 == 0), bytearray(x.tobytes())) for i, x in enumerate(ids)], "kind int, ids binary"))
    whole = {k: sorted(x.tobytes() for i, x in enumerate(ids) if (i % 4 == 0) == bool(k)) for k in (0, 1)}
    a, b = (np.bincount(np.frombuffer(b"".join(whole[k]), np.int32), minlength=toxicity.SPACE) for k in (1, 0))
    use = toxicity.telling(a, b, 50, 150)
    assert use[7] and not use[9] and use.sum() < 5
    assert {k: [x.tolist() for x in v] for k, v in rows.items()} == {k: [x[use[x]].tolist() for x in (np.frombuffer(x, np.int32) for x in v)] for k, v in whole.items()}
    assert toxicity._telling_rows(spark.createDataFrame([(1, bytearray(b""))], "kind int, ids binary")) is None


# shingle sets


def groups(rows):
    sets = []
    for i, t in rows:
        ws = (t or "").encode().translate(jaccard_join.LOWER).split()
        sets.append((i, frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_jaccard_join_matches_brute_force(spark, chunk):
    rows = texts(12, 120, 90) + HARD
    got = jaccard_join.near_duplicates(frame(spark, rows), chunk=chunk)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()), key=str) == groups(rows)
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0


def test_lists_are_read_by_the_block(monkeypatch):
    r = np.random.default_rng(4)
    base = [r.choice(3000, n, replace=False) for n in (20, 60, 61, 75, 150, 180)]
    sets = [np.unique(np.concatenate([r.choice(b, int(len(b) * r.uniform(0.8, 1)), replace=False), r.integers(0, 3000, 3)])) for b in base for _ in range(12)]
    ids, read = np.arange(len(sets)) * 7 + 1, []
    plain = jaccard_join.list_blocks

    def watched(index, m, codes, low, high):
        a, b = plain(index, m, codes, low, high)
        read.append(int((b - a).sum()))
        for code, x, y in zip(codes, a, b):
            assert all(low <= v % m < high and v // m == code for v in index[x:y])
        return a, b

    monkeypatch.setattr(jaccard_join, "list_blocks", watched)
    got = dict(jaccard_join.spanning_links(sets, ids))
    parent = {int(i): int(i) for i in ids}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(int(ids[a])), find(int(ids[b]))
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent if find(i) != i} and len(got) > 10
    assert 0 < sum(read) < sum(len(s) for s in sets) * len(sets) / 4


def test_one_row_of_each_component_stays(spark):
    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    near = lambda a: text(a) + " end"
    rows = [(1, text("a")), (5, near("a")), (5, text("clean")), (7, text("b")), (7, text("b")), (7, text("b"))]  # a repeated id with two texts, repeated rows
    rows += [(None, text("c")), (None, near("c")), (None, text("c")), (None, near("a")), (9, text("d")), (None, near("d"))]  # null ids
    rows += [(20, ""), (20, ""), (None, None), (3, text("e")), (3, text("f"))]
    got = jaccard_join.keep_representatives(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    kept = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    c = [x for x in kept if x[1] in (text("c"), near("c"))]
    assert len(c) == 1 and c[0][0] is None
    want = [(1, text("a")), (5, text("clean")), (7, text("b")), (9, text("d")), (20, ""), (20, ""), (None, None), (3, text("e")), (3, text("f"))]
    assert [x for x in kept if x not in c] == sorted(want, key=str)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    body = lambda n: " ".join(word() for _ in range(n))
    item, common = body(30), body(12)
    clean = [(i, body(60) + "\n" + (common if i % 2 else body(12))) for i in range(300)]
    toxic = [(1000 + i, body(20) + " zzidiot " + body(20)) for i in range(120)]
    extra = [(2000, clean[5][1]), (2001, " ".join(clean[6][1].split()[:-1])), (2002, body(20) + " " + item + " " + body(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + toxic + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in clean[:200] + toxic[:90]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    ids = {i for i, _ in clean}
    assert len(kept["toxicity"] & set(range(1000, 1120))) <= 3 and len(ids - kept["toxicity"]) <= 3
    assert kept["line dedup"] == kept["toxicity"]
    assert len((ids & kept["toxicity"]) - kept["n-gram jaccard join"]) == 0
    assert 2002 in kept["n-gram jaccard join"] and 2002 not in kept["benchmark decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == kept["benchmark decontamination"]
    check_packed(packed, packing.CAPACITY)


def test_pipeline_of_hard_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [*HARD, (5, "five words stand here now\nfive words stand here now"), (6, "five words stand here now")]
    for name, own in (("some", rows), ("none", [])):
        docs = frame(spark, own).withColumn("score", F.lit(7)).withColumn("n_lines", F.lit("own")).withColumn("n_chars", F.length("text").cast("long"))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{name}")
            assert now.columns == docs.columns and now.where("score <> 7 OR n_lines <> 'own'").count() == 0
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        check_packed(packed, packing.CAPACITY)
        assert {x.doc_id for x in packed} == ({1, None, 2, 3, 4, 5, 6} if own else set())
