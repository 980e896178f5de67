import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from tests.books import fold, says


def values(spark, column, xs, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r["y"] for r in frame.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_fold_equals_unicode_rules(spark):
    rng = random.Random(1)
    char = lambda: chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF))))
    xs = ["Velouté", "VELOUTE", "  Béchamel  ", "—  —", "œufs", "½ ß ﬁ", "№ 5", "été", "İı", "", *("".join(char() for _ in range(10)) for _ in range(5000))]
    assert values(spark, text.fold, xs) == [fold(x) or None for x in xs]


def test_fold_can_refuse(spark):
    assert values(spark, text.fold_or_raise, ["Roux", None]) == ["roux", None]
    with pytest.raises(Exception, match="empty concept id"):
        values(spark, text.fold_or_raise, ["***"])


def test_lines_end_where_python_ends_them(spark):
    xs = ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "\n", "x\r\n"]
    assert values(spark, text.split_lines, xs) == [x.splitlines() for x in xs]


def test_strip_takes_every_white_space(spark):
    xs = ["\x1c a b 　\x85", "  ", "x"]
    assert values(spark, text.strip, xs) == [x.strip() for x in xs]


def test_headings(spark):
    xs = ["22—BROWN SAUCE ", " 22—X", "12345—X", "٣٢—Arabic digits", "7—", "7— ", "7-no"]
    got = values(spark, lambda c: F.struct(text.heading_number(c).alias("n"), text.heading_title(c).alias("t")), xs)
    assert [(r["n"], r["t"]) if r["n"] is not None else None for r in got] == [(22, "BROWN SAUCE"), None, None, (32, "Arabic digits"), None, (7, ""), None]


def test_titles_that_name_the_kind(spark):
    xs = ["HERB SAUCE", "SAUCE ROBERT", "EGGS WITH SAUCE", "HERB SAUCE WITH RICE", "COD, SAUCE VERTE", "SAUCES", "SAUCEPAN", "ÉSAUCE", "sauce", "FISH"]
    assert values(spark, text.says_kind, xs) == [says(x) for x in xs]


def test_terms_and_languages(spark):
    got = values(spark, text.terms_of, ["BROWN SAUCE OR ESPAGNOLE", "A, or  B.", "SAUCE ROBERT", "HOLLANDAISE SAUCE", "VELOUTÉ", "“MARROW” SAUCE", ".,—", "é"])
    assert [[tuple(t) for t in ts] for ts in got] == [
        [("BROWN SAUCE", "en", "brown-sauce"), ("ESPAGNOLE", "fr", "espagnole")], [("A", "en", "a"), ("B", "en", "b")], [("SAUCE ROBERT", "fr", "sauce-robert")],
        [("HOLLANDAISE SAUCE", "fr", "hollandaise-sauce")], [("VELOUTÉ", "fr", "veloute")], [("“MARROW” SAUCE", "en", "marrow-sauce")], [], [("é", "en", "e")],
    ]


def test_sentences_runs_and_cuts(spark):
    assert values(spark, text.sentences_of, ["One two. é! ; Three:four"]) == [[["one", "two"], ["three"], ["four"]]]
    grams = values(spark, lambda c: text.grams_of(c, F.lit(2)), [["a", "b", "c"], ["a"]], "array<string>")
    assert [[tuple(g) for g in gs] for gs in grams] == [[(0, "a-b"), (1, "b-c")], []]
    assert values(spark, text.opening_of, ["a\n \n\nb\n\nc"]) == ["a\n "]
    assert values(spark, lambda c: text.cut_prose(c, 3), ["abc", "abcde"]) == ["abc", "abc...\n[2 more characters, raise --chars to read them]"]
    assert values(spark, lambda c: text.cut_prose(c, -1), ["abc"]) == ["ab...\n[4 more characters, raise --chars to read them]"]
