"""Collected portals, reference lists, attribute accuracies, nearest rows and the search of boosted models."""

import json

import pytest
from pyspark.sql import functions as F

from lumetra.functions import text as T
from lumetra.operators import crawl, linkage, metrics, ml
from lumetra.sources import tables


def listing(portal, page, *links, base="https://p.example"):
    return portal, page, base, "<main>" + "".join(f'<a href="{x}">t</a>' for x in links) + "</main><nav><a href='https://p.example/out'></a></nav>"


LISTINGS = [
    listing("p", 1, "/n/1?utm=a", "/n/2#top", "https://p.example/n/1"),
    listing("p", 2, "/n/2", "/n/3", "/video/4", "https://other.example/n/9"),
    listing("p", 3, "/n/5"),
    ("p", 4, "https://p.example", None),
    listing("q", 7, "https://p.example/n/1", base=None),
]
ARTICLES = [
    ("https://p.example/n/1", 2, "<h1>late</h1>"),
    ("https://p.example/n/1", 1, "<h1>One <b>x</b></h1><article><p>a</p><p> </p><p>b</p></article>"),
    ("https://p.example/n/2", 1, "<article><p>c</p></article>"),
    ("https://p.example/n/5", 1, None),
    (None, 1, "<h1>none</h1>"),
]


def collected(spark, listings, articles=ARTICLES, **options):
    l = spark.createDataFrame(listings, "portal string, page_number int, base string, html string")  # noqa: E741
    a = spark.createDataFrame(articles, "url string, number int, html string")
    rows = crawl.collect_portal(l, a, "main", ["https://p.example/"], ["/video/"], **options).collect()
    assert len({(r.portal, r.url) for r in rows}) == len(rows)
    return {(r.portal, r.url.rsplit("/", 1)[1]): (r.page_number, r.fetched, r.title, r.content) for r in rows}


def test_portal_is_collected_once_a_url(spark):
    assert collected(spark, LISTINGS) == {
        ("p", "1"): (1, True, "One x", "a\nb"),
        ("p", "2"): (1, True, "sem-titulo", "c"),
        ("p", "3"): (2, False, None, None),
        ("p", "5"): (3, True, None, None),
        ("q", "1"): (7, True, "One x", "a\nb"),
    }


def test_portal_without_its_last_page(spark):
    got = collected(spark, LISTINGS, skip_last=True)
    assert set(got) == {("p", "1"), ("p", "2"), ("p", "3"), ("p", "5")}  # page 4 of p and page 7 of q are the last
    assert ("p", "5") not in collected(spark, LISTINGS[:3], skip_last=True)


def test_portal_of_nothing(spark):
    assert collected(spark, []) == {}
    assert collected(spark, LISTINGS, [])["p", "1"] == (1, False, None, None)


def test_reference_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"nome": " Rio do Sul "}, {"nome": "null"}, {"nome": None}, {"other": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"nome": "RIO DO SUL", "id": 3}))
    (tmp_path / "c.json").write_text('[{"nome": "Ita')
    (tmp_path / "d.json").write_text(json.dumps([{"nome": "Itá"}]))
    assert sorted(r.name for r in tables.read_reference_list(spark, str(tmp_path), "nome").collect()) == ["itá", "rio do sul"]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "part.txt").write_text('[{"nome": "A"}, {"nome": "b"}]\n{"nome": " B "}\n[{"nome"\n')
    assert sorted(r.name for r in tables.read_reference_list(spark, str(lines), "nome", lines=True).collect()) == ["a", "b"]


def test_attribute_accuracy(spark):
    rows = [(("a", 1), ("a", 2)), (("a", None), ("a", None)), (("b", 1), ("a", 1)), ((None, 1), ("a", None))]
    df = spark.createDataFrame(rows, "gold struct<x: string, y: int>, found struct<x: string, y: int>")
    got = {r.attribute: (r.rows, r.accuracy, r.macro_accuracy) for r in metrics.attribute_accuracy(df, ["x", "y"]).collect()}
    assert got == {"x": (4, 0.5, 0.5), "y": (4, 0.5, 0.5)}
    assert {(r.rows, r.accuracy) for r in metrics.attribute_accuracy(df.limit(0), ["x", "y"]).collect()} == {(0, None)}


def test_nearest_overall_takes_ties_by_id(spark):
    v = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    got = linkage.nearest_overall(v([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 1.0])]), v([(8, [1.0, 0.0]), (9, [0.0, 1.0])]), 2).collect()
    assert [(r.a, r.b, r.rank) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 8, 1), (5, 8, 2)]


@pytest.mark.parametrize("title, body, want", [("a", "b", "a b"), (None, "b", " b"), ("a", None, "a "), (None, None, " ")])
def test_title_and_text(spark, title, body, want):
    assert spark.createDataFrame([(title, body)], "t string, b string").select(T.title_and_text(F.col("t"), F.col("b"))).first()[0] == want


def test_boosted_grid_is_searched_short_and_refitted_long(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.tuning import ParamGridBuilder

    def small(kind, n):
        e = GBTClassifier(seed=1, maxIter=5, featuresCol="features", labelCol="label", weightCol="weight")
        return e, ParamGridBuilder().addGrid(e.maxDepth, [1, 2]).build()

    monkeypatch.setattr(ml, "estimator", small)
    rows = spark.createDataFrame([(i, float(i % 2), Vectors.dense([i % 2 + (i % 7) / 10, i % 3])) for i in range(60)], ["doc_id", "label", "features"])
    model = ml.select_model("gbt", rows, folds=2, search_rounds=2)
    assert model.bestModel.stages[-1].getNumTrees == 5 and len(model.avgMetrics) == len(model.stdMetrics) == 2
    assert max(model.avgMetrics) == 1.0
    assert {r.prediction == r.label for r in model.bestModel.transform(ml.with_class_weight(rows)).collect()} == {True}
