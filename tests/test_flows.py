import pytest
from pyspark.sql import functions as F

from millrace.functions.html import element_text
from millrace.plans import flows as P


def test_standard_items_and_training_set(spark):
    movie = P.Domain("movie", "imdbId", {"Title": "Title", "Genre": "Genre"}, ("description_synth", "text"), "Poster")
    df = spark.createDataFrame([("1", "Foo", "A|B", None, "plot", "http://p", "old"), ("2", "Bar", "nan", " s ", "plot", "no", None)], "imdbId string, Title string, Genre string, description_synth string, text string, Poster string, query string")
    queries = spark.createDataFrame([("1", ""), ("2", "a|b|c")], "key string, value string")
    out = {r.item_id: r for r in P.standard_items(df, movie, queries).collect()}
    assert out["1"].content_text == "Title: Foo\nGenre: A|B\nDescription: plot" and out["1"].query == "old" and out["1"].image_path == "http://p"
    assert out["2"].content_text == "Title: Bar\nDescription: s" and out["2"].query == "a|b|c" and out["2"].image_path == ""
    both = P.training_set([P.standard_items(df, movie, queries)], need_image=True)
    assert [r.item_id for r in both.collect()] == ["1"]


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "m", "A must-read bestseller. Fine.", "plot of a ship"), (2, "m", "The ship sails home.", "plot of a ship"), (3, "b", "The ship sails home.", None)], "id int, kind string, t string, s string")
    out = P.quality_report(df, "id", "t", "s", "kind")
    rules = {r.kind: r for r in out["rules"].collect()}
    assert rules["m"].promotion == 0.5 and rules["m"].sales_awards == 0.5 and rules["b"].promotion == 0.0
    assert out["copies"].first()["extra"] == 1 and out["near_copies"].count() == 0


def test_recommender(spark, tmp_path):
    items = spark.createDataFrame([("a", "movie", [1.0, 0.0], "A", {"year": "1999"}), ("b", "book", [0.0, 1.0], "B", None)], "item_id string, domain string, embedding array<double>, title string, extra map<string,string>")
    with pytest.raises(RuntimeError):
        P.Recommender(spark).predict([1.0, 0.0])
    r = P.Recommender(spark, encode=lambda q: [0.1, 1.0]).fit(items)
    r.save(str(tmp_path / "index"))
    r = P.Recommender(spark, encode=lambda q: [0.1, 1.0]).load(str(tmp_path / "index"))
    assert [x.item_id for x in r.predict("calm", 5).collect()] == ["b", "a"]
    assert [x.item_id for x in r.predict("calm", 5, "movie").collect()] == ["a"]
    assert r.item("a", "movie") == {"title": "A", "year": "1999"} and r.item("a", "book") is None
    assert r.health() == {"ready": True, "items": {"movie": 1, "book": 1}}
    with pytest.raises(ValueError, match="top_k"):
        r.predict("x", 0)


def test_config_round_trip():
    c = P.Config(patience=5)
    assert P.Config.from_json(c.to_json()) == c


def test_element_text(spark):
    page = '<div class="x"><p>short</p></div><div id="desc"><p>' + "word &amp; " * 20 + "</p><script>no</script></div>"
    got = spark.createDataFrame([(page,)], "h string").select(element_text(F.col("h"), "div", "desc").alias("a"), element_text(F.col("h"), "div", "x").alias("b")).first()
    assert got.a == ("word & " * 20).strip() and got.b is None
