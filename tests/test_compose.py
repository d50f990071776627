"""Composition and artifacts on small fixtures."""

from pyspark.sql import functions as F

from quire.operators import compose, lines
from quire.sources import artifacts


def test_outline_plan_and_packing(spark):
    outline = spark.createDataFrame([("b", 1, "Intro"), ("b", 2, "Caches and memories"), ("b", 3, "Missing"), ("b", 4, "End")], "book_id string, seq int, title string")
    heads = spark.createDataFrame([("b", 3, "intro"), ("b", 9, "2. Caches and memories"), ("b", 5, "End"), ("b", 20, "END")], "book_id string, line_no int, title string")
    found = compose.outline_lines(outline, heads)
    assert [(r.seq, r.line_no) for r in found.orderBy("seq").collect()] == [(1, 3), (2, 9), (3, None), (4, 20)]
    lengths = spark.createDataFrame([("b", 30)], "book_id string, n_lines long")
    assert [(r.start_line, r.end_line) for r in compose.plan(found, lengths).orderBy("start_line").collect()] == [(3, 8), (9, 19), (20, 30)]
    packed = compose.packed_chapters(spark.createDataFrame([("b", i, n) for i, n in enumerate((5, 5, 30, 4, 4, 4))], "book_id string, seq int, n_pages int"), 10)
    assert [r.part for r in packed.orderBy("seq").collect()] == [0, 0, 1, 2, 2, 3]


def test_outlines_of_like_titles_make_no_pairs(spark):
    """3,000 entries and headings that all match each other (9 million pairs): a book's pass sees a few rows for each."""
    titles = spark.range(1, 3001).selectExpr("'b' as book_id", "id as seq", "concat('Chapter on things ', id) as title")
    out = compose.outline_lines(titles, titles.withColumnRenamed("seq", "line_no"))
    assert out.where("line_no = seq").count() == 3000


def test_headings_are_cut_where_they_are_read(spark):
    from quire.plans import line_queries

    plan = line_queries.headings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("substring(text") > plan.index("Exchange hashpartitioning")


def test_titles_pieces_are_not_broadcast_and_short_headings_are_whole(spark, monkeypatch):
    keys = spark.createDataFrame([("b", "theendofallthings", 1), ("b", "anotherlongtitle", 2), ("c", "theendofallthings", 3)], "book_id string, key string, entry long")
    heads = spark.createDataFrame([("b", "end", 10), ("b", "xtheendofallthingsx", 11), ("b", "therlongtitle", 12), ("b", "long", 13), ("c", "ending", 14)], "book_id string, heading string, of long")
    want = [("b", 1, 10), ("b", 1, 11), ("b", 2, 12), ("b", 2, 13)]
    found = compose.inside(keys, heads)
    assert sorted(map(tuple, found.collect())) == want
    # The short headings and their sizes; pieces are shuffled.
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 2 * 2
    monkeypatch.setattr(compose, "FEW", 1)
    large = compose.inside(keys, heads)
    assert sorted(map(tuple, large.collect())) == want
    plan = large._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3


def test_rendering(spark):
    text = "## 3.1 Title\nSome `code` & text that is long enough.\n- one\n- two\nx = 1;\n\ny = 2;"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    k = lines.kinds(docs)
    out = compose.rendered_blocks(lines.blocks(k), k)
    got = [r.html for r in out.orderBy("start_line").collect()]
    assert got == ["<h2>3.1 Title</h2>", "<p>Some <code>code</code> &amp; text that is long enough.</p>", "<ul><li>one</li>\n<li>two</li></ul>", "<pre><code>x = 1;\n\ny = 2;</code></pre>"]
    titles = spark.createDataFrame([(1, "A & B")], "doc_id int, title string")
    assert "<title>A &amp; B</title>" in compose.chapters(out, titles).first().xhtml


def test_rewrite_and_joins(spark):
    df = spark.createDataFrame([("a/b a/bc", [("a/b", "1"), ("a/bc", "2")])], "t string, n array<struct<`from`:string,`to`:string>>")
    assert df.select(compose.rewritten(F.col("t"), F.col("n")).alias("x")).first().x == "1 2"
    breaks = spark.createDataFrame([("b", 1, 2, "goes on in the mid-", "dle of a word"), ("b", 2, 3, "not in the", "layer at all")], "book_id string, page_no int, next_no int, left string, right string")
    layer = spark.createDataFrame([("b", 1, "x goes on in the mid-"), ("b", 2, "head dle of a word"), ("b", 3, "z")], "book_id string, page_no int, text string")
    assert [tuple(r) for r in compose.verified_joins(breaks, layer).collect()] == [("b", 1, 2, "")]


def test_artifacts(spark):
    files = spark.createDataFrame([("c1", p) for p in ("x/full.md", "a.md", "auto/c1_content_list.json", ".hidden/full.md", "deep/er/model.json", "model.json")], "bundle string, path string")
    assert {(r.role, r.path) for r in artifacts.located(files).collect()} == {("markdown", "x/full.md"), ("content_list", "auto/c1_content_list.json"), ("model", "model.json")}
    names = spark.createDataFrame([("p10",), ("p9",), ("P2",)], "n string")
    assert [r.n for r in names.orderBy(artifacts.natural_key(F.col("n"))).collect()] == ["P2", "p9", "p10"]
    raw = spark.createDataFrame([("a", bytearray("﻿é".encode())), ("b", bytearray("中文".encode("gb18030")))], "path string, content binary")
    assert {r.path: r.text for r in artifacts.decoded(raw).collect()} == {"a": "é", "b": "中文"}
