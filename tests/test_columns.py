from pyspark.sql import functions as F

from parecer.functions import fixed_values as fv
from parecer.functions import ladders, measures, text
from parecer.operators import orders
from tests.conftest import order, rows


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_delay_is_cut_toward_zero_or_floored(make):
    t = make(orders=[order("a", -0.5), order("b", 0.9), order("c", -1.0), order("d", 1.0),
                     order("e", -1.5)])
    cut = dict(rows(orders.with_truncated_delay(t["orders"]), "order_id", "delay_days"))
    assert cut == {"a": 0, "b": 0, "c": -1, "d": 1, "e": -1}
    floored = dict(rows(orders.with_floored_delay(t["orders"]), "order_id", "delay_days"))
    assert floored == {"a": -1, "b": 0, "c": -1, "d": 1, "e": -2}


def test_delivered_filters(make):
    t = make(orders=[order("a"), order("b", arrived=False), order("c", status="shipped")])
    assert orders.filter_delivered(t["orders"]).count() == 1
    assert orders.filter_delivered(t["orders"], arrival=False).count() == 2


def test_bucket_edges(spark):
    df = column(spark, [-11, -10, -9, -4, -3, -1, 0, 1, 3, 4, 10, 11, None], "int")
    got = rows(df, fv.DELAY_LADDER.rank(F.col("x")))
    assert [r[0] for r in got] == [0, 0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6]
    assert rows(df.where("x = -3"), fv.DELAY_LADDER.label(F.col("x"))) == [(">提前1-3天",)]
    cut = ladders.cut(F.col("x"), fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)
    assert rows(df.where("x = -3"), cut) == [("提前3-10天",)]


def test_cut_leaves_outside_null(spark):
    df = column(spark, [-200, -199, 200, 201, None], "int")
    cut = ladders.cut(F.col("x"), fv.DELAY_CUT_EDGES, fv.DELAY_CUT_LABELS)
    assert [r[0] for r in rows(df, cut)] == [None, "提前10天+", "延迟>10天", None, None]


def test_score_classes_and_levels(spark):
    df = column(spark, [0, 1, 2, 3, 4, 5, 6], "int")
    cut = ladders.cut(F.col("x"), fv.SCORE_CUT_EDGES, fv.SCORE_CUT_LABELS)
    bad, mid, good = fv.SCORE_CUT_LABELS
    assert [r[0] for r in rows(df, cut)] == [None, bad, bad, mid, good, good, None]
    level = ladders.level(F.col("x"), (0, 3), ("a", "b", "c"))
    assert [r[0] for r in rows(df, level)] == ["a", "b", "b", "b", "c", "c", "c"]


def test_freight_and_installment_buckets(spark):
    ratio = column(spark, [0.0, 0.1, 5.0, 10.0, 20.0, 30.0, 30.1, None], "double")
    got = [r[0] for r in rows(ratio, fv.FREIGHT_LADDER.label(F.col("x")))]
    assert got == ["0%", "0-5%", "0-5%", "5-10%", "10-20%", "20-30%", "30%+", "30%+"]
    n = column(spark, [0, 1, 2, 6, 10, 11], "int")
    got = [r[0] for r in rows(n, fv.INSTALLMENT_LADDER.label(F.col("x")))]
    assert got == ["2-3期", "1期", "2-3期", "4-6期", "7-10期", "10期+"]


def test_clip_and_phrase(spark):
    df = column(spark, [-40, -3, 0, 60, None], "int")
    assert [r[0] for r in rows(df, measures.clip(F.col("x"), -30, 50))] == [-30, -3, 0, 50, None]
    phrase = rows(df.where("x is not null"), measures.delay_phrase(F.col("x")))
    assert [r[0] for r in phrase] == ["提前40天", "提前3天", "0天(准时)", "+60天"]


def test_rounding_ignores_the_order_of_summation(spark):
    df = column(spark, [2.7949999999999995, 2.795, 0.25, -0.25], "double")
    assert [r[0] for r in rows(df, measures.rounded(F.col("x"), 2))] == [2.8, 2.8, 0.25, -0.25]
    even = [r[0] for r in rows(df, measures.rounded_even(F.col("x"), 1))]
    assert even == [2.8, 2.8, 0.2, -0.2]


def test_rates_keep_nulls_in_the_denominator(spark):
    df = column(spark, [1, -1, None, None], "int")
    assert rows(df.agg(measures.rate_of(F.col("x") > 0)))[0][0] == 25.0
    empty = df.where("x > 5").agg(measures.rate_of(F.col("x") > 0))
    assert rows(empty)[0][0] is None


TEXTS = [
    None, "", "https://a.b/c?d=1", "NÃO até 100%", "Über-cor", "foo http://x.y　bar baz",
    "  Olá,\nmundo!! ", "HTTP://X.Y/z atraso",
]
CLEANED = ["", "", " ", "não até ", " ber cor", "foo  bar baz".replace("  ", " "),
           " olá mundo ", " atraso"]


def test_clean_text(spark):
    got = [r[0] for r in rows(column(spark, TEXTS, "string"), text.clean_text(F.col("x")))]
    assert got == CLEANED


def test_words_are_those_of_the_cleaned_text(spark):
    df = column(spark, TEXTS, "string")
    pairs = rows(df, text.clean_text(F.col("x")), text.words(F.col("x")))
    for cleaned, words in pairs:
        assert [w for w in words if w] == cleaned.split()


def test_tokenize_drops_short_and_stop_words_and_keeps_repeats(spark):
    df = column(spark, ["A entrega atrasou, atrasou muito e NÃO veio ok"], "string")
    got = rows(df, text.tokenize(F.col("x"), fv.STOPWORDS))[0][0]
    assert got == ["atrasou", "atrasou", "não"]
    plain = rows(df, text.tokenize(F.col("x"), fv.STOPWORDS, strip_accents=True))[0][0]
    assert plain == ["atrasou", "atrasou"]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "x array<string>")
    got = [r[0] for r in rows(df, text.with_bigrams(F.col("x")))]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]
    split = column(spark, ["abc÷de f gh"], "string")
    assert rows(split, text.vector_words(F.col("x")))[0][0] == ["abc", "de", "gh"]
