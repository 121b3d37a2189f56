"""Titles: hand-derived values and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinscout.functions import text
from twinscout.operators.matching import title_overlap


def evaluate(spark, values, expression, schema="x string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(expression).collect()]


def test_clean_title(spark):
    given_titles = [
        "Rear View", "rear, view", "REARVIEWMIRROR", "3.5mm 1,000", None, "rear  view",
        "café-bar", "a b", "a\x1cb",
    ]
    expected = [
        "rearview", "rear  view", "rearview mirror", "3 5mm 1 000", "", "rear  view",
        "caf -bar", "a b", "a\x1cb",
    ]
    assert evaluate(spark, given_titles, text.clean_title(F.col("x"))) == expected


def test_unicode_space_does_not_join_words_but_splits_them(spark):
    titles = ["rear view", "a\x1cring"]
    assert evaluate(spark, titles, text.title_keywords(F.col("x"))) == [["rear", "view"], ["ring"]]


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("A - B", "C - D", 0.5),
        ("the a", "ring", 0.0),
        ("red ring", "red ring x6", 1.0),
        ("image 1 2", "image 1 2", 0.0),
        ("ring ring", "ring gold", 1.0),
    ],
)
def test_overlap(spark, a, b, expected):
    assert evaluate(spark, [(a, b)], title_overlap(F.col("a"), F.col("b")), "a string, b string") == [expected]


def mismatch(spark, pairs):
    pair = text.strict_mismatch(F.col("fa"), F.col("fb"))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = rows.withColumn("fa", text.title_features(F.col("a"))).withColumn("fb", text.title_features(F.col("b")))
    return [r[0] for r in rows.orderBy("i").select(pair).collect()]


def test_strict_mismatch(spark):
    pairs = [
        ("x6", "d007"), ("x6", "ring"), ("phone 14", "phone 15"), ("phone 12", "phone 13"),
        ("ring pro", "ring"), ("2-in-1 ring", "128gb ring"), ("cable 007", "cable 7"),
        ("cable 3.5mm", "cable 5mm"), ("x6 x7 ring", "x7 ring"), ("ring 21", "ring"),
    ]
    expected = [True, False, True, False, True, True, False, False, False, True]
    assert mismatch(spark, pairs) == expected


def test_model_codes_and_numbers(spark):
    titles = ["2-in-1 x6 007 abc- -z9 a--b 12-34 c3-", "000 14 014 x14"]
    assert [sorted(m) for m in evaluate(spark, titles, text.model_codes(F.col("x")))] == [
        ["2-in-1", "c3", "x6", "z9"], ["x14"],
    ]
    assert [sorted(n) for n in evaluate(spark, titles, text.title_numbers(F.col("x")))] == [
        ["1", "12", "2", "34", "7"], ["0", "14"],
    ]


def test_numbers_and_modifiers_that_tell_products_apart(spark):
    titles = ["Phone 14 Pro 128 021", "mini PRO-max air"]
    assert evaluate(spark, titles, text.telling_numbers(F.col("x"))) == [["14", "21"], []]
    assert evaluate(spark, titles, text.title_modifiers(F.col("x"))) == [["pro"], ["air", "mini"]]


def test_fixed_lists_have_their_sizes():
    assert len(set(text.STOP_WORDS)) == 21
    assert len(set(text.SPEC_NUMBERS)) == 51
    assert len(set(text.MODIFIERS)) == 13


titles = st.lists(
    st.lists(
        st.sampled_from(["x6", "d007", "ring", "pro", "14", "2-in-1", "the", "-", "RED", "3.5mm", "max", "0", "café"]),
        max_size=6,
    ).map(" ".join),
    min_size=2, max_size=30,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(titles)
def test_pair_properties(spark, batch):
    pairs = [(a, b) for a, b in zip(batch, reversed(batch))]
    rows = spark.createDataFrame(pairs, "a string, b string")
    rows = rows.withColumn("fa", text.title_features(F.col("a"))).withColumn("fb", text.title_features(F.col("b")))
    there, back, same, ratio, ratio_back = zip(
        *rows.select(
            text.strict_mismatch(F.col("fa"), F.col("fb")), text.strict_mismatch(F.col("fb"), F.col("fa")),
            text.strict_mismatch(F.col("fa"), F.col("fa")), title_overlap(F.col("a"), F.col("b")),
            title_overlap(F.col("b"), F.col("a")),
        ).collect()
    )
    assert there == back and not any(same)
    assert ratio == ratio_back and all(0.0 <= r <= 1.0 for r in ratio)
