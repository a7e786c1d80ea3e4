"""Worked examples of the text and number functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import categories as C
from millrace.functions import numbers as N
from millrace.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize(
    ("made", "expected"),
    [
        (lambda: T.title_key(L("Dune (Chronicles #1): A Novel!")), "dune"),
        (lambda: T.author_key(L("Rowling, J.K.")), "rowling"),
        (lambda: T.author_key(L("J.K. Rowling")), "rowling"),
        (lambda: T.item_key(L(None).cast("string"), L(None).cast("string")), "nan|nan"),
        (lambda: T.isbn(L("080442957x")), "080442957X"),
        (lambda: T.isbn(L("9999999999999")), ""),
        (lambda: T.isbn(L("9.78044E+12")), ""),
        (lambda: N.short_year(L("09/14/08")), "2008"),
        (lambda: N.short_year(L("09/14/85")), "1985"),
        (lambda: N.year_between(L("2002.0")), "2002"),
        (lambda: N.year_between(L("0")), ""),
        (lambda: T.first_parts(L("[Output]\na|b|c|d")), "a|b|c"),
        (lambda: T.first_parts(L("a|b")), None),
        (lambda: T.first_parts(L("a||c|d")), None),
        (lambda: C.category(L("Vampires")), "Horror"),
        (lambda: C.category(L("Comic strips")), "Comics/Graphic Novels"),
        (lambda: C.category(L("Short stories, English")), "Short Stories"),
        (lambda: C.category(L("xyz")), "Other"),
        (lambda: N.popularity(L(483), L(2503), L(1179)), 14776),
        (lambda: T.strip_year(L("Toy Story (1995)")), "Toy Story"),
        (lambda: T.json_list(L("A|B")), '["A", "B"]'),
        (lambda: T.json_list(L(None).cast("string")), "[]"),
        (lambda: T.strip_wrapping(L('"A quiet film."')), "A quiet film."),
        (lambda: T.strip_wrapping(L('"Best Friend," from his album, evokes "quiet warmth"')), '"Best Friend," from his album, evokes "quiet warmth"'),
        (lambda: N.audio_phrases(L(0.8), L(None).cast("double"), L(0.2), *[L(None).cast("double")] * 4, L(120.5), L(None).cast("double")), "high-energy and intense, melancholic and somber, mid-tempo tempo (~120 BPM)"),
        (lambda: T.genre_list(L("['Fantasy', \"Children's\", 'c']"), 2), "Fantasy, Children's"),
        (lambda: T.genre_list(L("Fantasy")), "Fantasy"),
        (lambda: T.clean_description(L('Instant New York Times bestseller! "A wonder of a book." — The Reviewer. Two girls find their way home.')), "Two girls find their way home."),
        (lambda: T.clean_description(L("Over 2 million copies sold! A tale.")), "A tale."),
        (lambda: T.grade(L("Answer: A")), "a"),
        (lambda: T.why_invalid(L("[Output]")), "labels only"),
        (lambda: T.why_invalid(L(" ")), "empty output"),
        (lambda: T.why_invalid(L("a||b")), "empty part"),
        (lambda: T.strip_roles(L("J.K. Rowling, Mary GrandPré (Illustrator)")), "J.K. Rowling, Mary GrandPré"),
        (lambda: T.tidy_punctuation(L("...disease. ,In 1918 , it")), "...disease. In 1918, it"),
        (lambda: T.strip_titles(L('In "Blue", Red Song (live) plays'), L("red song (live)")), "In  ,   plays"),
        (lambda: T.shown(F.create_map(L("b"), L("2"), L("a"), L("1"), L("c"), L(""))), "a: 1 | b: 2"),
        (lambda: T.strip_links(L('Bio.  <a href="x">Read more</a>')), "Bio."),
        (lambda: N.year_of(L("2009.0")), "2009"),
        (lambda: N.year_of(L("99")), None),
        (lambda: N.first_of_year(L("2009.0")), "2009-01-01"),
        (lambda: N.whole(L("1.5")), None),
        (lambda: T.keep_label_lines(L("Title: x\nGenre: y"), L(True)), "Genre: y"),
        (lambda: T.first_of_json_list(L('["x", "y"]')), "x"),
        (lambda: T.larger_artwork(L("http://h/100x100bb.jpg")), "http://h/600x600bb.jpg"),
    ],
)
def test_examples(spark, made, expected):
    assert value(spark, made()) == expected


def test_null_texts_do_not_fail(spark):
    none = L(None).cast("string")
    for f in (T.clean, T.title_key, T.author_key, T.strip_roles, T.tidy_punctuation, T.isbn, T.json_list, T.from_json_list, T.strip_year, T.first_parts, T.why_invalid, T.words, T.shingles, T.sentences, T.grade, T.genre_list, T.clean_description, T.strip_wrapping, T.strip_links, T.host, C.category):
        value(spark, f(none))


def test_pearson(spark):
    a, b = F.array(*[L(float(x)) for x in (1, 2, 3)]), F.array(*[L(float(x)) for x in (2, 4, 6)])
    assert value(spark, N.pearson_similarity(a, b)) == pytest.approx(1, abs=1e-6)


def test_description_is_cleaned_to_the_end(spark):
    texts = ["1 million copies sold! " * 12 + "Prose.", "Don't miss it, available now. Over 5 copies sold #1 New York Times bestseller. 2 copies sold! Tale", "Prose, 5 copies sold!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_description(F.col("t")))
    assert [r[0] for r in df.collect()] == ["Prose.", "Tale", "Prose, 5 copies sold!"]
