"""Gates on hand-made rows."""

from pyspark.sql import functions as F

from kilnwork.operators import curation as c


def test_gates(spark):
    df = spark.createDataFrame([(100, 500), (300, 300), (2000, 300), (130, 130)], "w int, h int")
    assert [r[0] for r in df.select(c.decoration(F.col("w"), F.col("h"))).collect()] == [True, False, True, True]
    df = spark.createDataFrame([("thin films",), ("the film",), ("J. K.",), ("2020",), ("ab",), (None,), ("one two three four five six",), ("March",)], "x string")
    assert [r[0] for r in df.select(c.valid_keyword(F.col("x"))).collect()] == [True] + [False] * 7
    long = "The films were measured with care and the hardness was found to increase with the number of cycles."
    df = spark.createDataFrame([(long,), ("short.",), (None,), ("Received 1 May. " + long,)], "x string")
    assert [r[0] for r in df.select(c.admissible(F.col("x"))).collect()] == [True, False, False, False]


def test_conclusion_and_offsets(spark):
    s = spark.createDataFrame([(1, 0, "body", "ab"), (1, 1, "body", None), (1, 2, "references", "abc"), (2, 0, "body", "x"), (2, 1, "conclusion", "y"), (2, 2, "body", "z")], "d int, o int, k string, t string")
    got = {(r["d"], r["o"]): r["k"] for r in c.with_conclusion(s, "d", "o", "k").collect()}
    assert got[1, 1] == "conclusion" and got[2, 2] == "body"
    assert sorted(tuple(r) for r in c.running_offsets(s.where("d = 1"), "d", "o", "t").collect()) == [(1, 0, 0, 2), (1, 1, 2, 2), (1, 2, 2, 5)]


def test_sizes_and_clusters(spark):
    df = spark.createDataFrame([(1,), (10,), (1000,), (10**9,)], "n long")
    assert [r[0] for r in df.select(c.target_size(F.col("n"))).collect()] == [10, 15, 99, 200]
    assert c.clusters({"a": {1, 2, 3}, "b": {3, 4}, "c": {9}, "d": {4, 5}}) == [["a", "b", "d"], ["c"]]
