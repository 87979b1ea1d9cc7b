"""Hand-made cases of the string, date and array functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumetra.functions import dates as D
from lumetra.functions import python_udfs as U
from lumetra.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("empresários manipularam o pregão presencial n. 36/2018", ["36/2018"]), ("processo licitatório n. 013/2022", ["013/2022"]), ("O edital 13/2021 foi cancelado", ["13/2021"]), ("Concorrência CC184/2021 sob investigação", ["CC184/2021"]), (None, [])])
def test_editals(spark, text, want):
    assert one(spark, text, T.editals) == want


@pytest.mark.parametrize(("text", "want"), [("013/2022", "13/2022"), ("000/2023", "0/2023"), ("a/b/c", "a/b/c"), (None, None)])
def test_edital_norm(spark, text, want):
    assert one(spark, text, T.edital_norm) == want


@pytest.mark.parametrize(
    ("parser", "text", "want"),
    [
        (D.iso_or_portuguese, "24 jul 2025 às 14h38", dt.date(2025, 7, 24)), (D.iso_or_portuguese, "setembro 2, 2026", dt.date(2026, 9, 2)), (D.iso_or_portuguese, "2025-07-24T14:38:34-03:00", dt.date(2025, 7, 24)),
        (D.iso_or_portuguese, "2025-07-24T23:38:34-03:00", dt.date(2025, 7, 24)), (D.dmy, "03/05/2025 - 10:00", dt.date(2025, 5, 3)), (D.other_format, "2 de março de 2026", dt.date(2026, 3, 2)), (D.other_format, "01/02/2026 às 09h30Atualizada agora", dt.date(2026, 2, 1)),
        (D.first_ten, "24/07/2025 10h00Atualizado", dt.date(2025, 7, 24)), (D.dmy, "31/02/2025", None), (D.iso_or_portuguese, None, None), (D.other_format, "", None),
    ],
)
def test_dates(spark, parser, text, want):
    assert one(spark, text, parser) == want


def test_tokens_keep_numbers_and_hyphens(spark):
    assert one(spark, "4,443.36 em 2025 na quarta-feira", T.pt_tokens) == ["4,443.36", "em", "2025", "na", "quarta-feira"]


def test_heavy_preprocess(spark):
    assert one(spark, "<b>A Licitação</b> nº 4.443,36 https://x.y/z do Ex-Prefeito!", T.heavy_preprocess) == "licitacao nº 4.443,36 ex-prefeito"


def test_identity_norm(spark):
    assert one(spark, "Aquisição  de MATERIAL...", T.identity_norm) == one(spark, "aquisicao de material", T.identity_norm)


@pytest.mark.parametrize(("gold", "got", "strict", "want"), [("a, b", ["A", "b", "c"], False, "TP"), ("a, b", ["A", "b", "c"], True, "FP"), (None, [], True, "TN"), (None, ["x"], False, "FP"), ("x", [], True, "FN"), ("a", ["z"], False, "FN"), ("a", ["z"], True, "FP")])
def test_attribute_class(spark, gold, got, strict, want):
    row = spark.createDataFrame([(gold, got)], "g string, p array<string>").select(T.attribute_class(F.col("g"), F.col("p"), strict).alias("y")).first()
    assert row.y == want


@pytest.mark.parametrize(("answer", "want"), [("0", 0), ("3", -1), ("A opção 2.", 2), ("nenhuma", -1), (None, -1)])
def test_answer_choice(spark, answer, want):
    assert one(spark, answer, lambda c: T.answer_choice(c, F.lit(2))) == want


def test_json_strings(spark):
    f = lambda c: T.json_strings(c, "edital")
    assert one(spark, '{"edital": "x"}', f) == ["x"]
    assert one(spark, '{"edital": 5}', f) == ["5"]
    assert one(spark, '```json\n{"edital": ["a", "a", ""]}\n```', f) == ["a"]
    assert one(spark, "broken", f) == []


def test_python_functions():
    assert U.first_json_object('say {"a": "}"} now {') == '{"a": "}"}'
    assert U.first_json_object("none") is None
    assert round(U.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    chunks = U.split_text("\n\n".join("word " * 60 for _ in range(5)))
    assert all(len(c) <= 600 for c in chunks) and len(chunks) >= 3
    assert U.stem("2025") == "2025" and U.stem("licitacoes") == U.stem("licitacao")


def test_arrow_functions_hold_few_python_objects(spark):
    """a batch of ten thousand texts, or all its tokens, was Python objects at once."""
    import pyarrow as pa

    seen = []
    kept = U.by_parts(pa.array(["a", None, "b"] * 200), lambda t: seen.append(t) or t, pa.string(), 100)
    assert len(seen) == 600 and kept.to_pylist() == seen and not U.by_parts(pa.array([], pa.string()), str, pa.string())
    rows = spark.createDataFrame([(["casas", "casas", "2018"],), (None,), ([],), (["rapidamente"],)], "t array<string>")
    got = [r.s for r in rows.select(U.stemmed()("t").alias("s")).collect()]
    assert got == [[U.stem("casas")] * 2 + ["2018"], None, [], [U.stem("rapidamente")]]
