import pytest
from pyspark.sql import functions as F

from lodestead.operators import answers


def processed(spark, raw, n):
    return spark.createDataFrame([(raw,)], "r string").select(answers.processed("r", F.lit(n)).alias("p")).first().p


@pytest.mark.parametrize(
    ("raw", "n", "text", "cited", "refused"),
    [
        ("It costs $49 [9].", 1, "It costs $49.", [], False), ("A [1]. B [1]. C [2].", 2, "A [1]. B [1]. C [2].", [1, 2], False), ("<think>never ends", 2, "", [], True), ("<think>x</think> Yes [1]", 1, "Yes [1]", [1], False),
        ("Sorry, NOT_FOUND here.", 2, "", [], True), ("Uncited.", 2, "Uncited.", [], False), ("", 1, "", [], True), (None, 1, "", [], True), ("[7] [8]", 2, "", [], True), ("B [2] A [1] [99999999999]", 2, "B [2] A [1]", [2, 1], False),
    ],
)
def test_processed(spark, raw, n, text, cited, refused):
    p = processed(spark, raw, n)
    assert (p.text, p.cited, p.refused) == (text, cited, refused)


@pytest.mark.parametrize(
    ("text", "sources", "want"),
    [("We are 34 people", "We are 34 people", False), ("We are 19 people", "We are 34 people", True), ("10000 rows", "10,000 rows", False), ("10,000 rows", "10000 rows", False), ("It is 49.", "49 dollars", False), ("in 1 or 2", "", False), ("", "x", False)],
)
def test_numbers(spark, text, sources, want):
    row = spark.createDataFrame([(text, sources)], "t string, s string").select(answers.unsupported_number("t", "s").alias("u")).first()
    assert row.u is want


@pytest.mark.parametrize(("text", "n", "want"), [("A [1] B [2].", 2, ["A ", 1, " B ", 2, "."]), ("A [9].", 2, ["A [9]."]), ("", 2, []), ("[1]", 1, [1])])
def test_split(spark, text, n, want):
    parts = spark.createDataFrame([(text,)], "t string").select(answers.split_citations("t", F.lit(n)).alias("p")).first().p
    assert [p["index"] if p.kind == "citation" else p.text for p in parts] == want


def test_packing(spark):
    def taken(*sizes):
        rows = spark.createDataFrame([([("t", [], "x" * n) for n in sizes],)], "c array<struct<title:string,heading_path:array<string>,body:string>>")
        return rows.select(answers.packed_sources("c").alias("t"), answers.prompt(F.lit("why?"), "c").alias("p")).first()

    assert taken(3000, 10).t == [0] and taken(1000, 2000, 1000).t == [0, 2] and taken(1, 1, 1, 1, 1).t == [0, 1, 2, 3] and taken().t == []
    assert taken(3000).p.startswith("Sources:\n\n[1] t\n" + "x" * 900 + "…") and taken(3).p.endswith("Question: why?")


def test_verdict(spark):
    rows = [("a", "It costs 49", ["49"], None, ["19"], "correct"), ("b", "It costs 19", ["49"], None, ["19"], "wrong-figure"), ("c", None, ["49"], None, None, "no-answer"), ("d", "ABC", ["abc", "x"], True, None, "correct"), ("e", "abc", ["abc", "x"], False, None, "missed-fact"), ("f", "x", None, None, None, "correct")]
    df = spark.createDataFrame(rows, "i string, a string, m array<string>, o boolean, n array<string>, want string")
    assert all(r.v == r.want for r in df.select("want", answers.verdict("a", "m", "o", "n").alias("v")).collect())
