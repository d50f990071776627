"""Operators on patterns that the tables lack."""

import json
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as X
from quire.operators import detect, diff, edits, formulas, geometry, interval_edits, lines, lint, package, pages, segments, state, tables, translate
from quire.sources import archives, artifacts


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, text, expression):
    return rows(spark, [(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("n", "cap", "chunks", "last"), [(386, 50, 20, 6), (18, 50, 1, 18), (1200, 50, 50, 24)])
def test_chunk_plans(spark, n, cap, chunks, last):
    plan = pages.chunk_plan(rows(spark, [("b", n, 1000)], "book_id string, page_count int, byte_size long"), max_chunks=cap).orderBy("page_start").collect()
    assert len(plan) == chunks and plan[-1].page_end == n - 1 and plan[-1].page_end - plan[-1].page_start + 1 == last


def test_page_stamps(spark):
    for text, want in (("另58一个没有", [58]), ("第58页", []), ("约58个", []), ("另007一", []), ("了一58元", []), ("句。12（", [12])):
        assert one(spark, text, detect.page_stamps) == want


def test_patterns_and_latex(spark):
    p = rows(spark, [("b", 1, "a &amp;&amp; b"), ("b", 2, "□"), ("b", 3, "中 o 文"), ("b", 4, "clean")], "book_id string, page_no int, text string")
    assert {(r.detector, r.page_no) for r in detect.pattern_counts(p).collect()} == {("double_amp", 1), ("broken_glyph", 2), ("isolated_o", 3)}
    q = rows(spark, [("b", 1, "x=x_{2}，左侧"), ("b", 2, "设 \\lim_{x}"), ("b", 3, "$x_{2}$ and $$\\lim$$")], "book_id string, page_no int, text string")
    assert {r.page_no for r in detect.bare_latex(q).collect()} == {1, 2}


def test_upper_median_and_overlap(spark):
    p = rows(spark, [("b", i, i, "x" * n) for i, n in enumerate((0, 500, 1000, 2000))], "book_id string, page_no int, doc_id int, text string")
    assert {(r.detector, r.evidence) for r in detect.short_pages(p).collect()} == {("empty_page", "1000")}
    run = " ".join(f"word{i}" for i in range(60))
    q = rows(spark, [("b", 1, "start " + run), ("b", 2, run + " end"), ("b", 3, "other")], "book_id string, page_no int, text string")
    assert [(r.page_no, r.n >= 120) for r in detect.adjacent_overlaps(q).collect()] == [(1, True)]


def test_line_kinds(spark):
    cases = {"$ make all": "code", "a = b": "code", "- item": "bullet", "## 3.1 x": "heading", "## bsc -v": "code", "$$x$$": "math", "": "blank", "and": "prose", "<table>": "html", "This is the line that we have read and it is long.": "prose", "foo_bar.baz": "code", "x;": "code"}
    got = {r.line: r.kind for r in rows(spark, [(k,) for k in cases], "line string").withColumn("kind", lines.line_kind(F.col("line"))).collect()}
    assert got == cases


def test_blocks_bridge_blank_lines_in_code_only(spark):
    text = "x = 1;\n\ny = 2;\nThis is quite plain prose\n\nmore of that same prose\n- a\n\n- b\nplain"
    got = [(r.start_line, r.end_line, r.kind) for r in lines.blocks(lines.kinds(rows(spark, [(1, text)], "doc_id int, text string"))).orderBy("start_line").collect()]
    assert got == [(1, 3, "code"), (4, 4, "prose"), (6, 6, "prose"), (7, 9, "bullets"), (10, 10, "prose")]


def test_headings_contents_and_titles(spark):
    level = lambda t: one(spark, t, lines.heading_level)
    assert [level(t) for t in ("3.1 x", "3.1.4 x", "3 x", "BEQ LABEL", "plain")] == [2, 3, 4, None, 4]
    assert tuple(one(spark, "Caches .... 12, 50", lines.toc_tail)) == ("Caches", "12, 50")
    assert one(spark, "A $x$ b", lines.toc_title) == "A b" and one(spark, "$x$", lines.toc_title) == "$x$"
    toc = rows(spark, [(1, i, lv) for i, lv in enumerate((1, 3, 1, 2, 2, 3))], "toc int, seq int, level int")
    assert [r.parent_seq for r in lines.toc_parents(toc).orderBy("seq").collect()] == [None, 0, None, 2, 2, 4]


def test_boxes(spark):
    b = lambda v: rows(spark, [(v,)], "v array<double>").select(geometry.bbox(F.col("v")).alias("b")).first().b
    assert tuple(b([1.0, 2.0, 3.0, 4.0])) == (1, 2, 3, 4) and tuple(b([0.0, 0.0, 2.0, 0.0, 2.0, 3.0, 0.0, 3.0])) == (0, 0, 2, 3) and b([1.0]) is None and b(None) is None
    s = lambda v: one(spark, v, geometry.score_norm)
    assert [s(v) for v in ("0.42", "42", "120", None)] == [0.42, 0.42, None, None]


@pytest.mark.parametrize(("top", "size", "want"), [(1.0, (0, 0), "unit"), (595.0, (595, 842), "pixels"), (900.0, (0, 0), "thousand"), (5000.0, (0, 0), None)])
def test_coordinate_systems(spark, top, size, want):
    df = rows(spark, [("b", [0.0, 0.0, top, top / 2], *map(float, size))], "bundle string, v array<double>, width double, height double")
    assert geometry.coordinate_systems(df.withColumn("box", geometry.bbox(F.col("v")))).first().system == want


def test_worst_line_of_a_paragraph(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    t = rows(spark, [(1, 0, (0.0, 0.0, 1.0, 1.0)), (2, 0, (5.0, 5.0, 6.0, 6.0))], f"target_id int, page int, box {box}")
    layout = rows(spark, [(0, (0.0, 0.0, 1.0, 0.3), 1.0, "a"), (0, (0.0, 0.3, 1.0, 0.6), 0.42, "b"), (0, (0.0, 0.6, 1.0, 1.0), 1.0, "c"), (1, (0.0, 0.0, 1.0, 1.0), 0.1, "d")], f"page int, box {box}, score double, source string")
    assert [tuple(r) for r in geometry.layout_scores(t, layout).collect()] == [(1, 0.42, "layout:b", 3)]


def test_tables(spark):
    rows_ = {r.page_no * 10 + r.ord: r for r in tables.inventory(rows(spark, [(1, "表1-2 甲 <table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>a</td><td>b</td></tr></table>"), (2, None), (3, "<table><tr>" + "<td>x</td>" * 9 + "</tr></table>")], "page_no int, text string")).collect()}
    assert rows_[11].caption == "表1-2 甲" and rows_[11].ragged == "2" and rows_[11].cols == 3 and rows_[31].needs_image


def test_page_diffs_and_furniture(spark):
    pairs = rows(spark, [(1, "same text", "same text"), (2, "a" * 10 + "this run is missing on the other side entirely", "a" * 10)], "page_no long, left string, right string")
    got = diff.layer_diff(pairs).collect()
    assert [(r.page_no, r.direction) for r in got] == [(2, "left_only")]
    assert one(spark, "head\na\n\nb\n7", diff.drop_furniture) == "a\n\nb" and one(spark, "a\nb", diff.drop_furniture) == "a\nb"


def test_matcher_equals_difflib():
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(1)
    for k in range(60):
        a = "".join(rng.choices("abcd " if k % 2 else "ab", k=rng.randint(0, 300)))
        b = a[50:] + "x" * (k % 3) + a[:150] if k % 4 == 0 else "".join(rng.choices("abcd " if k % 2 else "ab", k=rng.randint(0, 300)))
        assert diff.Matcher(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert diff._automaton(a, b)[2] == diff.longest_common(a, b)[2]
        assert not b or diff._automaton(a, b) == diff.longest_common(a, b)


def test_kinds_are_found_once_for_those_who_filter_or_batch_them(spark):
    docs = rows(spark, [(1, "Some text that is here.\n- one line\n\nx = 1;")], "doc_id int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    asked = lines.translatable(lines.kinds(docs))
    assert plan(asked.select("doc_id", "line_no", "kind")).count("endmodule") == 1
    assert plan(translate.batches(asked)).count("endmodule") == 1 and plan(translate.batches(asked)).count("Scan") == 1


def test_scores_that_stop_early_equal_counts(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "of", "The", "is", "théorie", "cat", "x", "_the", "the9", "by-by", "中the", "AB", "in\u2028on"])
    data = [(" ".join(word() for _ in range(rng.randint(0, 14))) + rng.choice(["", ".", ")", " "]),) for _ in range(400)]
    c = F.col("t")
    words, hits = F.regexp_count(c, F.lit("[A-Za-z]{2,}")), lines.prose_hits(c)
    want = F.when(words < 8, 0).when((hits >= 4) & c.rlike(r"[.:;)\]]$"), 2).when(hits >= 6, 1).otherwise(0)
    needed = F.regexp_count(c, F.lit("[A-Za-z]")) >= 4
    got = rows(spark, data, "t string").select(lines.prose_score(c).alias("a"), want.alias("b"), X.needs_translation(c).alias("x"), needed.alias("y")).collect()
    assert all(r.a == r.b and r.x == r.y for r in got) and {r.a for r in got} == {0, 1, 2}


def test_overlaps_are_found_once_and_fast(spark):
    from difflib import SequenceMatcher

    rng = random.Random(9)
    for _ in range(200):
        text = lambda n: "".join(rng.choice("ab") for _ in range(n))
        a = text(rng.randint(0, 40)) * rng.randint(1, 3)
        b = text(rng.randint(0, 20)) + a[rng.randint(0, 9) :] + text(9)
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert m.size < 9 or detect.longest_run(a, b, 5) == tuple(m)
    began = time.perf_counter()
    assert detect.longest_run("ab" * 1000, "ab" * 2000, 60) == (0, 0, 2000) and time.perf_counter() - began < 5
    book = rows(spark, [("b", 1, "x"), ("b", 2, "y")], "book_id string, page_no int, text string")
    plan = detect.adjacent_overlaps(book)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_cells_are_counted_once_for_a_condition_on_them(spark):
    row = lambda n: "<tr>" + "<td>x</td>" * n + "</tr>"
    page = rows(spark, [(1, "<table>" + row(3) + row(2) + row(1) + row(3) + "</table> <table></table>")], "page_no int, text string")
    out = tables.inventory(page).where("ragged <> ''").select("page_no", "ord", "rows", "cols", "ragged")
    assert [tuple(r) for r in out.collect()] == [(1, 1, 4, 3, "2")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("<td.*?</td>") == 1


def test_page_diffs_equal_difflib_and_end_on_long_pages():
    def plain(a, b, least):
        share = lambda run, other: sum(x.size for x in diff.Matcher(run, other).get_matching_blocks()) / len(run)
        count = lambda x: sum(map(str.isalnum, x))
        for op, a0, a1, b0, b1 in diff.Matcher(a, b).get_opcodes():
            for name, run, other in (("left_only", a[a0:a1], b), ("right_only", b[b0:b1], a)):
                if op != "equal" and count(run) >= least and share(run, other) < diff.PRESENT:
                    yield name, count(run), run[:120]

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["ab", "c", "abc", "d", "-", "é"]) for _ in range(n))
    for _ in range(60):
        a = text(rng.randint(0, 90))
        b = text(30) + a[rng.randint(0, 20) : rng.randint(20, 90)] + text(rng.randint(0, 60))
        assert diff.page_diffs(a, b, 3) == list(plain(a, b, 3))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    began = time.perf_counter()
    long = [" ".join(word() for _ in range(8_000)) for _ in range(2)]
    assert len(diff.page_diffs(*long)) > 10 and time.perf_counter() - began < 20


def test_short_ranges_are_searched_as_strings(monkeypatch):
    """Most of the ranges of two texts that have little in common are short: few are worth an array's search, and both ways agree."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(300)) for _ in range(3)]
    pairs = [(texts[0], texts[1]), (texts[1], texts[2]), (texts[0], texts[0][:900] + texts[2] + "é中" + texts[0][700:])]
    calls, common = [], diff.Pair.common
    monkeypatch.setattr(diff.Pair, "common", lambda self, *a: calls.append(a) or common(self, *a))
    got, many = [diff.page_diffs(a, b, 5) for a, b in pairs], len(calls)
    monkeypatch.setattr(diff, "SMALL", -1)
    assert got == [diff.page_diffs(a, b, 5) for a, b in pairs] and sum(map(len, got)) > 20
    assert many * 3 < len(calls) - many


def test_layer_diff_of_whole_normalised_texts(spark):
    from quire.plans.line_queries import diff_pairs

    long = "".join(f"sentence number {i} of this page. " for i in range(60))
    spaced = long.replace(" ", "\n ").replace("page", "<b>Page</b>").replace("of", "o&#102;")
    data = [(1, long, long + "Only the “right” side has these words at its end."), (2, long, spaced), (3, "it’s – “so” " * 20, 'it\'s - "so" ' * 20)]
    got = diff.layer_diff(rows(spark, data, "page_no long, left string, right string")).collect()
    assert [(r.page_no, r.direction) for r in got] == [(1, "right_only")] and got[0].snippet.endswith("words at its end.")
    pairs = diff_pairs(spark, "/root/testdata/sf0.001").agg(F.max(F.length("left")).alias("a"), F.max(F.length("right")).alias("b")).first()
    assert min(pairs.a, pairs.b) > 600


def test_edits(spark):
    books = rows(spark, [("b", "one two sepa-\nrated three two"), ("c", "x")], "book_id string, text string")
    schema = "book_id string, seq int, op string, find string, with_ string, expect int, occurrence int"
    good = rows(spark, [("b", 1, "join", "sepa-", "", None, None), ("b", 2, "replace", "three", "3", None, None), ("b", 3, "replace", "three", "3", None, None), ("b", 4, "regex", "tw.", "2", 2, None)], schema)
    got = {(r.book_id, r.seq): (r.status, r.text) for r in edits.applied(books, good).collect()}
    assert got[("b", -1)] == ("written", "one 2 separated 3 2") and got[("b", 3)][0] == "skipped" and got[("c", -1)] == ("written", "x")
    bad = rows(spark, [("b", 1, "replace", "one", "1", None, None), ("b", 2, "replace", "two", "2", None, None)], schema)
    got = {(r.book_id, r.seq): (r.status, r.text) for r in edits.applied(books, bad).collect()}
    assert got[("b", -1)] == ("refused", "one two sepa-\nrated three two") and got[("b", 2)][0] == "found 2 times, not 1"
    assert edits.apply_one("p\n\nq\n\np\n\nr", "drop_paragraph", "p", "", None, 2) == ("p\n\nq\n\nr", "done")


def test_translation(spark):
    src = rows(spark, [(1, 1, "ab cd"), (1, 2, "ef"), (2, 1, "gh")], "batch int, line_no int, line string")
    frag = rows(spark, [(1, 1, "ab ", "A"), (1, 2, "cd", "C"), (1, 3, "ef", "E"), (2, 1, "zz", "Z")], "batch int, seq int, src string, dst string")
    assert {tuple(r) for r in translate.regrouped(src, frag).collect()} == {(1, 1, "AC"), (1, 2, "E")}
    assert one(spark, "a `x` and $y$", lambda c: translate.restored(translate.protected(c))) == "a `x` and $y$"
    b = translate.batches(rows(spark, [(1, i, "x" * 40) for i in range(1, 8)], "doc_id int, line_no int, line string"), 100).orderBy("line_no")
    assert [r.batch for r in b.collect()] == [0, 0, 1, 1, 2, 2, 3]


def book(spark, **extra):
    chapter = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body><p id="a">x</p><a href="mailto:x@y">m</a></body></html>'
    items = [{"item_id": "c", "href": "c.xhtml", "media_type": "application/xhtml+xml", "properties": ""}, {"item_id": "n", "href": "nav.xhtml", "media_type": "application/xhtml+xml", "properties": "nav"}]
    opf = package.package_document({"title": "T", "language": "en", "identifier": "urn:uuid:demo"}, items, ["c.xhtml"], "2020-01-01T00:00:00Z")
    files = {"META-INF/container.xml": package.container_document("OEBPS/content.opf"), "OEBPS/content.opf": opf, "OEBPS/c.xhtml": chapter, "OEBPS/nav.xhtml": package.navigation([{"title": "A", "href": "c.xhtml", "level": 1}, {"title": "B", "href": "c.xhtml", "level": 3}, {"title": "C", "href": "c.xhtml", "level": 1}], "T"), "mimetype": "", **extra}
    return rows(spark, [("b", n, bytearray(t.encode())) for n, t in files.items()], "book_id string, name string, content binary")


def test_package_and_lint(spark, tmp_path):
    first, again = (package.archives(book(spark)).first().epub for _ in range(2))
    assert first == again
    (tmp_path / "b.epub").write_bytes(first)
    entries = archives.read_archives(spark, str(tmp_path / "b.epub"))
    assert entries.where("ord = 0").first().name == "mimetype" and entries.where("ord = 0").first().stored
    assert lint.lint(entries).collect() == []
    bad = book(spark, **{"OEBPS/c.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><head/><body><img src="../i/no.png"/><p id="a"/><p id="a"/><a href="https://x.y">r</a></body></html>', "OEBPS/d.xhtml": "<p>"})
    (tmp_path / "c.epub").write_bytes(package.archives(bad).first().epub)
    found = {(r.id, r.severity) for r in lint.lint(archives.read_archives(spark, str(tmp_path / "c.epub"))).collect()}
    assert {("RSC-005", "FATAL"), ("RSC-005", "ERROR"), ("ACC-001", "ERROR"), ("RSC-006", "ERROR"), ("RSC-007", "ERROR")} <= found
    (tmp_path / "d.epub").write_bytes(b"no zip")
    assert archives.read_archives(spark, str(tmp_path / "d.epub")).first().ord == -1
    assert [(r.id, r.severity) for r in lint.lint(archives.read_archives(spark, str(tmp_path / "d.epub"))).collect()] == [("PKG-001", "FATAL")]
    with zipfile.ZipFile(tmp_path / "e.epub", "w"):
        pass
    assert [(r.id, r.severity) for r in lint.lint(archives.read_archives(spark, str(tmp_path / "e.epub"))).collect()] == [("PKG-006", "FATAL")]
    for box, opf, want in (("<container/>", None, "no rootfile"), (package.container_document("no.opf"), None, "rootfile names a missing entry: no.opf"), (package.container_document("OEBPS/content.opf").replace("oebps-package", "x"), None, "rootfile media type: application/x+xml")):
        (tmp_path / "f.epub").write_bytes(package.archives(book(spark, **{"META-INF/container.xml": box})).first().epub)
        assert want in {r.message for r in lint.lint(archives.read_archives(spark, str(tmp_path / "f.epub"))).where("id = 'PKG-003'").collect()}
    lost = book(spark, **{"META-INF/container.xml": "<container/>", "OEBPS/second.opf": "<package/>"})
    (tmp_path / "g.epub").write_bytes(package.archives(lost).first().epub)
    assert "the package document can't be located" in {r.message for r in lint.lint(archives.read_archives(spark, str(tmp_path / "g.epub"))).collect()}
    gone = book(spark).where("name <> 'OEBPS/c.xhtml'")
    (tmp_path / "h.epub").write_bytes(package.archives(gone).first().epub)
    assert "the manifest names a missing file: c.xhtml" in {r.message for r in lint.lint(archives.read_archives(spark, str(tmp_path / "h.epub"))).collect()}
    assert package.identifier("https://x", "s") == "https://x" and package.identifier("urn:uuid:demo", "s") == package.identifier("", "s") != ""


def test_identifiers_and_times_of_a_package(spark):
    head = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0" unique-identifier="i"><metadata>'
    meta = '<dc:identifier id="i">x</dc:identifier><dc:identifier id="j"> </dc:identifier><dc:title>t</dc:title><dc:language>en</dc:language>'
    time = lambda v: f'<meta property="dcterms:modified">{v}</meta>'
    found = lambda x: {m for rule, _, m, _ in lint._package_issues((head + meta + x + '<item id="j"/></metadata></package>').encode()) if rule in ("OPF-001", "OPF-003")}
    twice = found(time("2020-01-01T00:00:00Z") + time("2021-01-01T00:00:00Z"))
    assert "empty dc:identifier" in twice and "id occurs more than once in the document: j" in twice and not any("modified" in m for m in twice)
    assert "no dcterms:modified" in found("") and "malformed dcterms:modified: 2020" in found(time("2020"))


def test_markup(spark):
    listing = lambda t: one(spark, t, markup.listing)
    assert listing(r"\begin {array} {ll} \mathrm{f o r} (i = 0 ; x [i ] ) \\ a \leftarrow b \& c \end {array}") == "for (i = 0 ; x [i])\na ← b c"
    assert one(spark, "&#65;&#x41;&lt;&#99999999;&nbsp;", markup.unescaped) == "AA<&#99999999;~"
    assert one(spark, "a < b <sub>2</sub> & <i>", markup.escaped_but_inline) == "a &lt; b <sub>2</sub> &amp; &lt;i&gt;"
    assert one(spark, "<td width=79% colspan=2>a\\nb", markup.table_attributes) == '<td width="79%" colspan="2">a<br/>b'
    assert [tuple(x) for x in one(spark, "325:1,497：1，12 3:", markup.page_orders)] == [(325, 1), (12, 1), (3, 1)]
    assert [one(spark, t, markup.is_asm_math) for t in ("assign x", "a; \\# 5", "x + y")] == [True, True, False]


def brute_binomials(latex):
    def after(at, skip):
        while at < len(latex) and latex[at].isspace():
            at += 1
        if not skip:
            return at
        depth = 0
        for i in range(at, len(latex)):
            depth += (latex[i] == "{") - (latex[i] == "}")
            if not depth:
                return i + 1
        return len(latex)

    out, at = "", 0
    while (found := latex.find("\\binom", at)) >= 0:
        end, groups = found + 6, 0
        while groups < 2 and latex[after(end, False) :][:1] == "{":
            end, groups = after(end, True), groups + 1
        scripted = groups == 2 and latex[after(end, False) :][:1] in ("^", "_")
        out += latex[at:found] + ("{" + latex[found:end] + "}" if scripted else latex[found:end])
        at = end
    return out + latex[at:]


TABLE_PAGES = {
    1: "表1-1 数据 <table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>",
    2: "x <table border=1><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>a</td><td>b</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table> 表 2.3 甲 <table><tr><td>q</td></tr></table>",
    3: "<table><tr>" + "<td>1</td>" * 9 + "</tr></table>",
    4: "表A-4（续）<table>" + ("<tr>" + "<td>12</td>" * 6 + "</tr>") * 15 + "</table>",
    5: "no table",
}


def test_inventory_of_odd_tables(spark):
    got = {(r.page_no, r.ord): (r.rows, r.cols, r.ragged, r.caption, r.needs_image) for r in tables.inventory(rows(spark, list(TABLE_PAGES.items()), "page_no int, text string")).collect()}
    assert got == {(1, 1): (2, 2, "", "表1-1 数据", False), (2, 1): (3, 3, "2", "", False), (2, 2): (1, 1, "", "表 2.3 甲", False), (3, 1): (1, 9, "", "", True), (4, 1): (15, 6, "", "表A-4（续）", True)}


PLAN = "book_id string, seq int, op string, find string, with_ string, expect int, occurrence int, right_head string"


def edited(spark, pages_, plan):
    outcomes, made = interval_edits.edited(rows(spark, pages_, "book_id string, page_no int, text string"), rows(spark, plan, PLAN))
    texts = {r.book_id: r.text for r in interval_edits.whole_texts(made).collect()}
    return texts, {(r.book_id, r.seq): r.status for r in outcomes.collect()}


def test_edits_become_intervals_on_pages(spark):
    pages_ = [("b", 1, "Head\nThe anchor. It is a System-"), ("b", 2, "  Verilog text 12 and 34"), ("b", 3, "drop\n\nkeep\n\ndrop\n\nend"), ("b", 4, None), ("c", 1, "one two two"), ("d", 1, "a b"), ("e", 1, "left  right (x.y) [1] $9")]
    plan = [
        ("b", 1, "append", "The anchor.", "[note]\nmore", None, None, None),
        ("b", 2, "join", "System-", "", None, None, "Verilog text"),
        ("b", 3, "regex", "([0-9])([0-9])", "$2$1", 2, None, None),
        ("b", 4, "drop_paragraph", "drop", "", None, 2, None),
        ("b", 5, "replace", "gone", "Head", None, None, None),
        ("b", 6, "regex", "nothing here", "", None, None, None),
        ("c", 1, "replace", "one", "ONE", None, None, None),
        ("c", 2, "replace", "two", "TWO", None, None, None),
        ("d", 1, "replace", "a b", "x", None, None, None),
        ("d", 2, "replace", "b", "y", None, None, None),
        ("e", 1, "join", "left", "", None, None, "right"),
        ("e", 2, "replace", "(x.y)", "\\1 $2", None, None, None),
    ]
    texts, status = edited(spark, pages_, plan)
    assert texts["b"] == "Head\nThe anchor.\n\n[note]\nmore It is a SystemVerilog text 21 and 43\ndrop\n\nkeep\n\nend\n"
    assert [status["b", k] for k in range(1, 7)] == ["done", "done", "done", "done", "skipped", "skipped"]
    assert texts["c"] == "one two two" and status["c", 1] == "done" and status["c", 2] == "found 2 times"
    assert texts["d"] == "a b" and status["d", 2] == "overlaps another edit"
    assert texts["e"] == "left right \\1 $2 [1] $9" and status["e", 1] == status["e", 2] == "done"


def test_edits_that_are_done_or_refused(spark):
    pages_ = [("a", 1, "x-ray y [note]"), ("b", 1, "p q"), ("b", 2, "p q"), ("c", 1, "p q")]
    plan = [("a", 1, "append", "y", "[note]\nz", None, None, None), ("a", 2, "join", "x-", "", None, None, "ray"), ("b", 1, "append", "p", "new", None, None, None), ("c", 1, "join", "p", "", None, None, "other"), ("c", 2, "nonsense", "p", "", None, None, None), ("c", 3, "drop_paragraph", "q", "", None, None, None)]
    texts, status = edited(spark, pages_, plan)
    assert texts == {"a": "x-ray y [note]", "b": "p q\np q", "c": "p q"}
    assert status == {("a", 1): "skipped", ("a", 2): "skipped", ("b", 1): "found 2 times", ("c", 1): "other text follows", ("c", 2): "unknown op", ("c", 3): "found 1 times"}


def test_a_book_of_many_pages_is_edited_on_its_pages(spark):
    """One book of 20,000 pages: a regular expression on all, and an anchor on one of them."""
    book = spark.range(20_000).selectExpr("'b' as book_id", "cast(id as int) as page_no", "concat('page ', id, ' end') as text")
    plan = rows(spark, [("b", 1, "regex", "page ([0-9]+)", "p. $1", 20_000, None, None), ("b", 2, "append", " 777 end", "note", None, None, None)], PLAN)
    outcomes, made = interval_edits.edited(book, plan)
    assert {r.status for r in outcomes.collect()} == {"done"}
    assert made.where("text = concat('p. ', page_no, ' end')").count() == 19_999 and made.where("page_no = 777").first().text == "p. 777 end\n\nnote"


def test_joins_need_an_anchor_that_occurs_once(spark):
    book = rows(spark, [("b", 1, "one two"), ("b", 2, "three"), ("b", 3, "x two")], "book_id string, page_no int, text string")
    breaks = rows(spark, [("b", 1, "one two", "three"), ("b", 2, "e", "x"), ("b", 3, "two", "y")], "book_id string, page_no int, left_tail string, right_head string")
    assert [(r.seq, r.find) for r in interval_edits.joins_of(breaks, book).collect()] == [(1, "one two")]


def test_binomials_are_grouped_at_any_depth(spark):
    cases = [r"\binom{\mathbf{u}}{\mathbf{J}_{m}\mathbf{u}}^\top", r"a\binom{n}{k} _2 + \binom {n} {k}", r"\binom{\binom{a}{b}^2}{c}^3", r"{\binom{a}{b}}{c}^2", r"\binom{a}^2{b}", r"\binom{a}{b}\binom{c}{d}^2", "", "x^2", r"{{\binom{a}{b}^{2}}}_3", r"\binom a b^2", r"\binom{" + "{" * 40 + "x" + "}" * 40 + r"}{y}^z", None]
    rng = random.Random(4)
    group = lambda d: "{" + rng.choice(["a", "", " x ", r"\frac{1}{2}"] + ([binom(d - 1), group(d - 1)] if d else [])) + "}"
    binom = lambda d: rng.choice(["", "y ", "z_"]) + r"\binom" + rng.choice(["", " "]) + group(d) + rng.choice(["", " "]) + group(d) + rng.choice(["", "^2", " _{i}", " "])
    cases += ["".join(binom(3) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    got = {r.id: r.latex for r in formulas.grouped_binomials(rows(spark, list(enumerate(cases)), "id int, latex string")).collect()}
    assert got == {i: None if c is None else brute_binomials(c) for i, c in enumerate(cases)}


def test_formulas_are_matched_without_a_shuffle(spark, capsys):
    formulas.grouped_binomials(rows(spark, [(1, r"\binom{a}{b}^2")], "id int, latex string")).explain()
    assert not {"Exchange", "Generate", "Window"} & set(re.findall(r"\w+", capsys.readouterr().out))


def test_deep_json_is_read(spark):
    deep = '{"a":[' * 20_000 + '{"score": 0.5, "text": "x", "page_idx": 3}' + "]}" * 20_000
    data = [("deep", deep), ("open", "[" * 100_000), ("odd", "[" * 50_000 + "}" * 50_000), ("fine", '[{"score": 50, "text": "y"}]')]
    got = {r.doc: (r.page_idx, r.text, r.score) for r in segments.scored_nodes(rows(spark, data, "doc string, value string")).collect()}
    assert got == {"deep": (3, "x", 0.5), "fine": (0, "y", 0.5)}
    assert segments.content_segments(rows(spark, [("d", "[" * 60_000)], "bundle string, value string")).count() == 0


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(8)
    box = lambda size: (x := rng.uniform(-0.1, 1.0), y := rng.uniform(0, 1.0), x + rng.uniform(0, size), y + rng.uniform(0, size))
    layout = [(p, box(rng.choice([0.02, 0.2, 1.2])), round(rng.random(), 3), f"b{i}") for i in range(600) for p in [i % 2]] + [(0, (0.0, 0.0, 1.0, 1.0), 0.99, "page"), (1, None, 0.1, "none")]
    targets = [(i, i % 3, box(rng.choice([0.02, 0.3]))) for i in range(200)] + [(900, 0, (0.5, 0.5, 0.5, 0.5)), (901, 0, None)]
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    want = {}
    for i, p, t in targets:
        for q, b, score, source in layout:
            if p == q and t and b:
                c = max(0, min(t[2], b[2]) - max(t[0], b[0])) * max(0, min(t[3], b[3]) - max(t[1], b[1]))
                if c > 0 and (c >= 0.5 * area(t) and area(t) > 0 or c >= 0.5 * max(area(b), 1e-9)):
                    want.setdefault(i, []).append((score, source))
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    got = geometry.layout_scores(rows(spark, targets, f"target_id int, page int, box {kind}"), rows(spark, layout, f"page int, box {kind}, score double, source string")).collect()
    assert {r.target_id: (r.score, r.source, r.hits) for r in got} == {i: (min(x)[0], "layout:" + min(x)[1], len(x)) for i, x in want.items()}


def test_a_page_of_many_boxes_is_joined_without_its_pairs(spark):
    """20,000 boxes and as many targets of one page: rows that meet in a cell grow with the boxes."""
    grid = spark.range(20_000).selectExpr("id", "(id % 141) / 141D as x", "(id div 141) / 142D as y")
    boxes = grid.selectExpr("id", "0 as page", "named_struct('x0', x, 'y0', y, 'x1', x + 0.006, 'y1', y + 0.006) as box")
    out = geometry.layout_scores(boxes.selectExpr("id as target_id", "page", "box"), boxes.selectExpr("page", "box", "0.5D as score", "string(id) as source"))
    assert out.where("hits = 1").count() == 20_000


def test_a_crowded_cell_is_compared_in_blocks_and_pairs_are_not_sorted(spark, monkeypatch):
    """300 targets and 401 boxes that touch one cell: blocks of 64 and 50, each with each, give what all pairs give; a null score is no least one."""
    monkeypatch.setattr(geometry, "BOXES", 50)
    monkeypatch.setattr(geometry, "TARGETS", 64)
    rng = random.Random(9)
    box = lambda: (x := rng.uniform(0, 0.2), y := rng.uniform(0, 0.2), x + rng.uniform(0.1, 0.9), y + rng.uniform(0.1, 0.9))
    layout = [(0, box(), rng.choice([None, 0.5, round(rng.random(), 2)]), f"b{i}") for i in range(400)] + [(0, (0.0, 0.0, 1.2, 1.2), 0.99, "page")]
    targets = [(i, 0, box()) for i in range(300)]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    want = {}
    for i, _, t in targets:
        for _, b, score, source in layout:
            c = max(0, min(t[2], b[2]) - max(t[0], b[0])) * max(0, min(t[3], b[3]) - max(t[1], b[1]))
            if c > 0 and (c >= 0.5 * area(t) or c >= 0.5 * area(b)):
                want.setdefault(i, []).append((score, source))
    want = {i: (*min(p for p in x if p[0] is not None), len(x)) for i, x in want.items()}
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    out = geometry.layout_scores(rows(spark, targets, f"target_id int, page int, box {kind}"), rows(spark, layout, f"page int, box {kind}, score double, source string"))
    assert {r.target_id: (r.score, r.source.removeprefix("layout:"), r.hits) for r in out.collect()} == want
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_result_lines(spark):
    page = lambda w, *b: {"prunedResult": {"width": w, "height": 200, "parsing_res_list": [{"block_label": k, "block_bbox": v} for k, v in b]}}
    line = lambda *p: json.dumps({"result": {"layoutParsingResults": list(p)}})
    data = [("b", 1, line(page(100, ("text", [0, 0, 50, 50])), page(100))), ("b", 2, line(page(100, ("image", [1, 2, 3, 4]), ("bad", [1]), ("text", None)))), ("b", 3, "no json"), ("c", 1, line(page(10, ("table", [0, 0, 2, 0, 2, 3, 0, 3]))))]
    got = {(r.bundle, r.page, r.label, tuple(r.box), r.width) for r in segments.parsed_boxes(rows(spark, data, "bundle string, line_no int, value string")).collect()}
    assert got == {("b", 0, "text", (0, 0, 50, 50), 100), ("b", 2, "image", (1, 2, 3, 4), 100), ("c", 0, "table", (0, 0, 2, 3), 10)}


def test_nodes_of_content_lists(spark):
    items = [{"text": " ", "score": 1}, {"TEXT": ["a ", "b"], "Scores": 1, "meta": {"Prob": 2, "CONF": "31"}, "page_number": 3, "table_caption": ["c"]}, {"img_path": "x.png", "score": True, "confidence": [1], "type": 7}, {"content": "d", "score": 120, "probability": "0.5", "poly": [0, 0, 2, 0, 2, 3, 0, 3]}]
    got = segments.content_segments(rows(spark, [("b", json.dumps(items)), ("c", "no json"), ("d", None)], "bundle string, value string")).collect()
    assert [(r.segment_id, r.page_idx, r.kind, r.text, r.score, r.source) for r in got] == [("S00001", 2, "unknown", "a b\nc", 0.31, "meta.conf"), ("S00002", 0, "category_7", "[图片] x.png", None, "none"), ("S00003", 0, "unknown", "d", 0.5, "probability")]
    assert tuple(got[2].box) == (0, 0, 2, 3)
    layout = rows(spark, [("b", 0, (0.0, 0.0, 0.1, 0.1), 0.2, "x"), ("b", 2, (0.0, 0.0, 1.0, 1.0), 0.3, "y")], "bundle string, page int, box struct<x0:double,y0:double,x1:double,y1:double>, score double, source string")
    seg = rows(spark, [("b", "S1", 0, (0.0, 0.0, 100.0, 100.0), None, "none"), ("b", "S2", 0, None, None, "none"), ("b", "S3", 2, (0.0, 0.0, 900.0, 900.0), 0.9, "score")], "bundle string, segment_id string, page_idx int, box struct<x0:double,y0:double,x1:double,y1:double>, score double, source string")
    systems = rows(spark, [("b", "thousand", 0.0, 0.0)], "bundle string, system string, width double, height double")
    out = {r.segment_id: (r.score, r.source, r.lines) for r in segments.layout_scored(seg, layout, systems).collect()}
    assert out == {"S1": (0.2, "layout:x", 1), "S2": (None, "none", 0), "S3": (0.9, "score", 0)}


def test_deep_nodes_and_texts_of_descendants(spark):
    deep = {"score": 0.5, "text": "x"}
    for _ in range(40):
        deep = {"a": [deep]}
    doc = {"pdf_info": [[{"score": 0.4, "lines": [{"text": "one"}, {"text": "two"}]}], {"page_no": 9, "b": deep}]}
    got = segments.scored_nodes(rows(spark, [(1, json.dumps(doc))], "doc int, value string")).orderBy("ord").collect()
    assert [(r.page_idx, r.text, r.score) for r in got] == [(0, "one two", 0.4), (8, "x", 0.5)]


def test_scores_are_no_booleans(spark):
    assert rows(spark, [(True,)], "v boolean").select(geometry.score_norm(F.col("v")).alias("x")).first().x is None
    assert one(spark, "true", geometry.score_norm) is None and one(spark, "x", geometry.score_norm) is None


def test_pages_of_a_hot_book_are_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE_IDS", 8)
    data = [(i * 3, f"t{i}", "hot" if i % 4 else None) for i in range(100)]
    got = pages.book_pages(rows(spark, data, "doc_id long, text string, source string")).collect()
    for book_ in ("hot", None):
        mine = sorted((r.page_no, r.doc_id) for r in got if r.book_id == book_)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [i for _, i in mine] == sorted(i for _, i in mine)


def test_findings_read_each_text_once_and_shuffle_none(spark):
    """The features come from one scan with the text; behind it, exchanges see features only."""
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text")
    plan = pages.book_pages(docs_, *detect.page_features(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("ReadSchema: ")[1:]]
    assert sum("text:string" in x.split("\n")[0] for x in scans) == 1
    assert not any("text#" in x for x in plan.split("\n") if "Exchange" in x or "Sort [" in x)
    found = detect.findings_of(docs_)
    assert "text:string" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_pages_with_sparse_ids_are_numbered_in_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE_IDS", 10)
    data = [(i * 1_000_003, f"t{i}", "one") for i in range(200)]
    got = pages.book_pages(rows(spark, data, "doc_id long, text string, source string"), F.length("text").alias("n"))
    assert got.columns == ["book_id", "page_no", "doc_id", "n"] and [r.page_no for r in got.orderBy("doc_id").collect()] == list(range(1, 201))
    assert pages.book_pages(rows(spark, data, "doc_id long, text string, source string").limit(0)).count() == 0


def test_trimming_is_pythons(spark):
    for t in ("\u3000 a b\t\n", "\x1f\x85x\u2028", "", " \n ", "é\u00a0", "a"):
        assert one(spark, t, X.ustrip) == t.strip()


def test_lines_of_a_file_in_many_blocks_are_numbered(spark, tmp_path):
    lines_ = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines_) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = archives.read_results(spark, str(tmp_path))
        got = {}
        for r in read.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.value
        assert read.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {"a.txt": {i + 1: x for i, x in enumerate(lines_)}, "b.txt": {1: "one", 2: "", 3: "three"}}


def test_files_that_no_role_names_and_bundles_of_no_use(spark):
    f = rows(spark, [("a", "x/full.md"), ("a", "x/odd.json"), ("a", "x/b_model.json"), ("b", "y/z.json"), ("b", "y/.hidden.json"), ("c", "c_content_list.json")], "bundle string, path string")
    assert sorted(map(tuple, artifacts.unclaimed(f).collect())) == [("a", "x/odd.json"), ("b", "y/z.json")]
    assert [tuple(r) for r in artifacts.unusable(f).collect()] == [("b", 2)]


def test_forced_and_invalidated_stages(spark):
    s = rows(spark, [("r", "a", 0, "DONE"), ("r", "b", 1, "DONE"), ("r", "c", 2, "DONE"), ("q", "a", 0, "FAILED"), ("q", "b", 1, "DONE")], "run_id string, stage string, ord int, status string")
    assert sorted((r.run_id, r.ord) for r in state.to_run(s, force=1).collect()) == [("q", 0), ("q", 1), ("r", 1), ("r", 2)]
    changed = rows(spark, [("r", 0), ("r", 1)], "run_id string, ord int")
    assert sorted((r.run_id, r.ord, r.status) for r in state.invalidated(s, changed).collect()) == [("q", 0, "FAILED"), ("q", 1, "DONE"), ("r", 0, "DONE"), ("r", 1, "PENDING"), ("r", 2, "PENDING")]


def test_resume_and_isolation(spark):
    s = rows(spark, [("r", "a", 0, "DONE"), ("r", "b", 1, "FAILED"), ("r", "c", 2, "DONE"), ("q", "a", 0, "DONE")], "run_id string, stage string, ord int, status string")
    assert [r.stage for r in state.to_run(s).orderBy("ord").collect()] == ["b", "c"] and [r.stage for r in state.to_run(s, 1).collect()] == ["b"]
    ls = rows(spark, [(1, 1, "x"), (2, 1, "y")], "batch int, line_no int, line string")
    again, fine = translate.isolated(rows(spark, [(1, False), (2, True)], "batch int, ok boolean"), ls)
    assert [r.line for r in again.collect()] == ["x"] and [r.line for r in fine.collect()] == ["y"]


def test_resolve(spark):
    df = rows(spark, [("a/b.xhtml", h) for h in ("../c/d.png?x#y", "/e.css", "f%20g.png", "./h")], "b string, h string")
    assert [r.x for r in df.select(lint.resolve(F.col("b"), F.col("h")).alias("x")).collect()] == ["c/d.png", "e.css", "a/f g.png", "a/h"]


def test_results_and_unknown_json(spark, tmp_path):
    line = lambda *t: json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": x, "images": {"k": "u"}}} for x in t]}})
    (tmp_path / "r.jsonl").write_text(line("a", "b") + "\n\n" + line("c"))
    got = segments.result_pages(archives.read_results(spark, str(tmp_path / "r.jsonl"))).orderBy("page_idx").collect()
    assert [(r.page_idx, r.text) for r in got] == [(0, "a"), (1, "b"), (2, "c")]
    doc = json.dumps({"pages": [{"page_index": 4, "regions": [{"label": "para", "confidence": 31, "text": "x"}, {"label": "no", "text": "y"}]}]})
    found = segments.scored_nodes(rows(spark, [(1, doc), (2, "broken")], "doc int, value string")).collect()
    assert [(r.page_idx, r.kind, r.score) for r in found] == [(4, "para", 0.31)]


def test_states(spark):
    s = rows(spark, [("r", "prepare", 1, "DONE"), ("r", "calibrate", 2, "SKIPPED"), ("r", "check", 4, "PENDING"), ("q", "prepare", 1, "DONE")], "run_id string, stage string, ord int, status string")
    assert [tuple(r) for r in state.first_incomplete(s).collect()] == [("r", "check")]
    none = rows(spark, [], "id string, severity string, path string, line int")
    assert tuple(lint.gate(none).first()) == (0, True)


def test_page_spec(spark):
    assert one(spark, "3, 5-7 9，3 x 0 8-6", pages.page_spec) == [3, 5, 6, 7, 9]


def test_excerpt_and_keys(spark):
    random.seed(1)
    text = "".join(random.choices("abc ", k=900)) + "NEEDLE here" + "z" * 500
    out = rows(spark, [(text, "NEEDLE here\nmore"), (text, "absent"), (text, " ")], "t string, n string").select(X.excerpt(F.col("t"), F.col("n"), 200).alias("x")).collect()
    assert out[0].x.startswith("…") and "NEEDLE" in out[0].x and len(out[0].x) == 202 and out[1].x == out[2].x == ""
    assert one(spark, "第三章 Caches!", X.title_key) == "第三章caches"
