from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import aggregates as agg, tokens
from tessella.functions import numeric, text
from tessella.functions.stemmer import stem


@pytest.mark.parametrize(
    ("value", "grams"),
    [
        ("ab cd", ["ab!", "a#", "a c", "cd!", "c#"]),
        ("Zip Code", ["zip!", "z#", "z c", "zip", "cod!", "c#", "cod", "ode"]),
        ("aaaa", ["aaa!", "a#", "aaa", "aaa"]),
        ("", []),
        ("   ", []),
        (None, []),
        ("É", ["é!", "é#"]),
    ],
)
def test_qgrams(spark, value, grams):
    row = spark.createDataFrame([(value,)], "t string").select(text.qgrams(F.col("t")).alias("g")).first()
    assert Counter(row["g"]) == Counter(grams)


def test_substring_functions(spark):
    df = spark.createDataFrame([("HomePhoneNumber", "phone,number"), ("aXa", "x"), ("abc", ""), (None, "a")], "t string, r string")
    assert [r[0] for r in df.select(text.remove_substrings(F.col("t"), F.col("r"))).collect()] == ["Home", "aa", "abc", None]
    one = spark.createDataFrame([("aba",), ("",)], "t string")
    rows = one.select(text.prefixes(F.col("t")).alias("p"), text.substrings(F.col("t")).alias("s")).collect()
    assert rows[0]["p"] == ["a", "ab", "aba"] and sorted(rows[0]["s"]) == ["a", "ab", "aba", "b", "ba"]
    assert rows[1]["p"] == [] and rows[1]["s"] == []
    assert one.where(text.text_filter(F.col("t"), F.lit("B a"))).count() == 1


def test_delimited_substrings():
    assert text.delimited_substrings("a1b") == ["1b", "a", "a1b"]
    assert "Phone" in text.delimited_substrings("homePhone_no1") and text.delimited_substrings("") == []


@given(st.text(alphabet="abc", min_size=1, max_size=8))
def test_partitions(value):
    parts = list(text.partitions(value))
    assert len(parts) == 2 ** (len(value) - 1) and all("".join(p) == value for p in parts)


def test_stems(spark):
    known = {"running": "run", "hopping": "hop", "hoped": "hope", "flies": "fli", "ponies": "poni", "caresses": "caress", "relational": "relat", "happiness": "happi", "nationality": "nation", "skies": "sky", "generously": "generous"}
    assert {w: stem(w) for w in known} == known
    df = spark.createDataFrame([("The running Dogs, 42 of them!",), (None,)], "t string")
    typed, plain, only = (df.select(f(F.col("t")).alias("x")).first()["x"] for f in (text.typed_stems, text.stems, text.word_stems))
    assert typed == ["1||", "1||run", "1||dog", "22||42", "1||", "1||"] and plain == ["run", "dog", "42"] and only == ["run", "dog"]


def test_typed_tokens(spark):
    rows = [
        ("well-known x-1y été-là", [(16, "well-known"), (11, "well"), (11, "known"), (15, "x-1y"), (11, "x"), (9, "1y"), (17, "été-là"), (10, "été"), (10, "là")]),
        ("http://example.com/a?q=1 foo.bar me@x.org", [(14, "http://"), (5, "example.com/a?q=1"), (6, "example.com"), (18, "/a?q=1"), (6, "foo.bar"), (4, "me@x.org")]),
        ("-5 3.14 1.2.3 2.5e10 42 &amp; <b class='x'> a1 état", [(21, "-5"), (20, "3.14"), (8, "1.2.3"), (7, "2.5e10"), (22, "42"), (23, "&amp;"), (13, "<b class='x'>"), (3, "a1"), (2, "état")]),
        ("", []),
        (None, []),
        (" ,;\n\t!", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in df.select("i", tokens.typed_tokens(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
    long = spark.createDataFrame([("a-" * 20_000 + "b",), ("x." * 20_000 + "com",), ("y" * 500_000,), ("<" * 5000,)], "t string")
    assert long.select(F.size(tokens.typed_tokens(F.col("t"))).alias("n")).where("n > 0").count() == 3


def test_dictionary_of_stems_equals_stems_of_texts(spark):
    df = spark.createDataFrame([(1, "The runs running, a well-known run of 42 runners"), (2, "runs and Runs"), (3, None)], "k long, t string")
    for f in (tokens.stems, tokens.typed_stems, tokens.word_stems, tokens.topic_stems):
        want = {}
        for r in df.select("k", F.explode(f(F.col("t"))).alias("x")).collect():
            want[r["k"], r["x"]] = want.get((r["k"], r["x"]), 0) + 1
        assert {(r["k"], r["x"]): r["c"] for r in f.counts(df, ["k"], "t", "x").collect()} == want
    assert ("42" not in {r["x"] for r in tokens.topic_stems.counts(df, ["k"], "t", "x").collect()}) and tokens.stems.counts(df.limit(0), ["k"], "t").isEmpty()


def test_identifier():
    assert text.check_identifier("a.b_1") == "`a`.`b_1`"
    with pytest.raises(ValueError):
        text.check_identifier("a; drop table b")


def test_to_num(spark):
    df = spark.createDataFrame([("1.5",), (" 2e3 ",), ("1d",), ("",), (None,), ("-.5",), ("x",)], "t string")
    assert [r[0] for r in df.select(numeric.to_num(F.col("t"))).collect()] == [1.5, 2000.0, None, None, None, -0.5, None]


def test_color(spark):
    df = spark.createDataFrame([(1.5,), (-1.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(numeric.color(F.col("x"))).collect()] == ["ff", "00", "7f"]


def test_welch():
    t, df, p = (float(x) for x in (numeric.welch(10, 12, 5, 6, 4, 9)[0], numeric.welch(10, 12, 5, 6, 4, 9)[1], numeric.welch(10, 12, 5, 6, 4, 9)[2][0]))
    assert (round(t, 6), round(df, 6), round(p, 6)) == (0.932505, 19.190546, 0.362660)
    assert numeric.t_test_values([1, 10, 10], [12, 12, 12], 5, 6, [4, 0, 4], 9).round(6).tolist() == [2, 3, 0.63734]
    assert abs(numeric.incomplete_beta(5, 0.5, 10 / (10 + 2.228139**2)) - 0.05) < 1e-6
    assert numeric.incomplete_beta(2, 3, 0) == 0 and numeric.incomplete_beta(2, 3, 1) == 1


@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.01, 0.99))
def test_incomplete_beta_symmetry(a, b, x):
    assert abs(numeric.incomplete_beta(a, b, x) + numeric.incomplete_beta(b, a, 1 - x) - 1) < 1e-9


def test_histogram(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 10)] + [("b", 1.0), ("c", 2.0), ("c", 2.0), ("d", None)], "k string, value double")
    found = numeric.histogram(rows, ["k"]).orderBy("k", "bucket").collect()
    assert [(r["k"], r["bucket"], r["n"]) for r in found] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]


def test_array_functions(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.4, 0.88], 0.6), ([0.1, 0.2], 0.9), ([], 0.5), ([1.0], None)], "v array<double>, t double")
    assert [r[0] for r in df.select(agg.cutoff(F.col("v"), F.col("t"))).collect()] == [0.4, 0.2, None, None]
    assert df.select(agg.kth(F.col("v"), 5).alias("k")).first()["k"] == 0.88 and df.select(agg.top(F.col("v"), 2).alias("k")).first()["k"] == [0.1, 0.2]


def test_group_concat(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, "a"), (2, None)], "k int, v string")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(agg.group_concat(F.col("v"), ";").alias("x")).collect()}
    assert got == {1: "a;b", 2: None}


def test_catalog(spark):
    from tessella.functions import catalog

    spark.range(1).createOrReplaceTempView("one_row")
    assert catalog.table_exists(spark, "one_row") and catalog.view_exists(spark, "one_row") and catalog.schema_exists(spark, "default") and not catalog.index_exists(spark, "x")
