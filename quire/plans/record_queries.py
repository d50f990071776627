"""Queries on parse results, reports, states, markup and work orders. Records that the tables lack are made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.operators import compose as C
from quire.operators import detect as D
from quire.operators import lint as I
from quire.operators import package as K
from quire.operators import pages as P
from quire.operators import segments as J
from quire.operators import state as S
from quire.operators import tables as H
from quire.operators import translate as R
from quire.plans.common import BK, BP, CP, docs, pages, quoted, table, us
from quire.plans.page_queries import low_pages, plan
from quire.streaming import folds


def content_lists(s, d):
    """A content list for each document: its text, with a score of its own, in a child object, or none, and an item without text."""
    meta = F.when(F.col("doc_id") % 3 == 1, F.struct((F.col("doc_id") % 100 / 100).alias("CONF")))
    own = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 130)
    item = F.struct(F.col("doc_id").alias("Page_No"), F.lit(" Title ").alias("category"), F.col("text").alias("Content"), own.alias("Score"), meta.alias("meta"), F.lit("c").alias("footnote"))
    return docs(s, d).select(F.col("doc_id").alias("bundle"), F.concat(F.lit("["), F.to_json(item), F.lit(',{"type":"x","text":" "}]')).alias("value"))


def results(s, d):
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit('[{"page_idx":'), F.col("doc_id"), F.lit('},{"page_idx":2},{"text":"x"}]'))).when(k == 1, "[]").otherwise(None)
    model = F.when(k == 1, F.lit('[{"a":1},{"a":2},{"a":3}]')).when(k == 2, F.lit('{"page_info":[1,2]}'))
    return docs(s, d).select(F.col("doc_id").alias("bundle"), content.alias("content"), model.alias("model"))


def reports(s, d):
    text = F.concat(F.lit("noise\nERROR(RSC-005): en/"), F.col("doc_id"), F.lit(".xhtml("), F.col("doc_id") % 50, F.lit(",7): "), F.substring(F.col("source"), 1, 9), F.lit(" is: wrong\n  WARNING(OPF-003): OEBPS/p.opf: twice\nINFO(CHK-1): done\n"))
    return table(s, d, "documents").select(text.alias("text"))


def messages(s, d):
    at = F.array(F.struct(F.lit("a.xhtml").alias("path"), (F.col("doc_id") % 9).alias("line"), F.lit(3).alias("column")), F.struct(F.lit("b.xhtml").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("column")))
    one = F.struct(F.lit("RSC-007").alias("ID"), F.lit("error").alias("severity"), F.col("source").alias("message"), F.slice(at, 1, (F.col("doc_id") % 3).cast("int")).alias("locations"))
    return table(s, d, "documents").select(F.to_json(F.struct(F.array(one).alias("messages"))).alias("value"))


def alerts(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("code"), F.col("props").alias("message"), F.element_at(F.array(*[F.lit(x) for x in S.LEVELS]), (F.col("event_id") % 4 + 1).cast("int")).alias("severity"), "ts", F.col("event_id").alias("alert_id"))


def states(s, d):
    value = F.when(F.col("doc_id") % 5 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"run_id":"r'), F.col("doc_id"), F.lit('","stage":"'), F.col("source"), F.lit('"}')))
    return table(s, d, "documents").select(F.col("doc_id").alias("file"), value.alias("value"))


def stages(s, d):
    """The four stages of each document's run; the one of its number is still open, later ones were done once."""
    status = F.when(F.col("ord") == F.col("doc_id") % 5, "FAILED").otherwise("DONE")
    return docs(s, d).select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in S.STAGES])).alias("ord", "stage")).select(F.col("doc_id").alias("run_id"), "stage", "ord", status.alias("status"))


def seam_pages(s, d):
    chars = P.page_chars_of(pages(s, d, P.text_chars(F.col("text")).alias("chars")))
    return P.seams(plan(s, d), chars).select("book_id", "left_page", "right_page")


def marked(s, d):
    return P.paged_pieces(pages(s, d).withColumn("chunk_id", F.format_string("c%03d", F.col("page_no") % 7)))


def lines_of(s, d):
    return docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def counted_tables(s, d):
    """Tables of every document, with so many rows and columns as its id says."""
    text = F.concat(F.lit("<table>"), F.expr("repeat(concat('<tr>', repeat('<td>x</td>', cast(doc_id % 9 + 1 as int)), '</tr>'), cast(doc_id % 20 + 1 as int))"), F.lit("</table>"))
    return docs(s, d).select(F.col("doc_id").alias("page_no"), text.alias("text"))


def flagged_stream(s, d):
    from quire.plans.box_queries import streamed

    as_pages = lambda st: st.select(F.col("url").alias("book_id"), F.col("page_id").alias("page_no"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return streamed(s, d, lambda st: folds.flagged_pages(as_pages(st), [D.pattern_counts]), "append", "pages")


def issues(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("R-"), F.col("doc_id") % 3).alias("id"), F.element_at(F.array(F.lit("ERROR"), F.lit("WARNING")), (F.col("doc_id") % 2 + 1).cast("int")).alias("severity"), F.col("source").alias("message"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 4).cast("int").alias("line"))


def books_json(s, d):
    value = F.concat(F.lit('{"title":" T '), F.col("doc_id"), F.lit('","author":'), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(',"language":"'), F.col("lang"), F.lit('"'))).otherwise(F.lit("")), F.lit(',"cover":"./c.png","spine":["./a.xhtml"," ","b\\\\c.xhtml"]}'))
    return table(s, d, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 7 == 0, F.lit("[1]")).otherwise(value).alias("value"))


def audits(s, d):
    value = F.concat(F.lit('{"seams":[{"index":1,"left_page":'), F.col("doc_id"), F.lit(',"right_page":'), F.col("doc_id") + 1, F.lit('},"broken",{"index":2}]}'))
    return docs(s, d).select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("{}")).otherwise(value).alias("value"))


def titled_blocks(s, d):
    """Blocks of each document behind its title, a chapter number, and a heading of its own."""
    first = lambda i, text: F.struct(F.lit(i).alias("ord"), text.alias("text"))
    made = F.array(first(0, F.lit("# T")), first(1, F.when(F.col("doc_id") % 2 == 0, F.lit("## 第 3 章")).otherwise(F.lit("## other"))), first(2, F.lit("# T")), first(3, F.col("text")))
    return docs(s, d).select(F.col("doc_id").alias("part"), F.explode(made).alias("b")).select("part", "b.ord", "b.text")


QUERIES = {
    "report_lines": lambda s, d: I.report_lines(issues(s, d), 5),
    "counts_json": lambda s, d: S.counts_json(issues(s, d).groupBy(F.col("id").alias("key")).agg(F.count("*").alias("n"))),
    "book_records": lambda s, d: K.book_records(books_json(s, d)).select("file", "title", "author", "language", "cover", F.array_join("spine", "|").alias("spine")),
    "repeated_targets": lambda s, d: K.repeated_targets(table(s, d, "documents").select(F.col("lang").alias("book_id"), F.col("doc_id").alias("ord"), F.col("source").alias("href"))),
    "well_formed_seams": lambda s, d: P.well_formed_seams(audits(s, d)),
    "bundle_order": lambda s, d: P.bundle_order(plan(s, d).select("book_id", F.col("chunk_id").alias("bundle")).unionByName(docs(s, d).select(F.concat(F.lit("x"), F.col("doc_id") % 5).alias("book_id"), F.col("doc_id").cast("string").alias("bundle"))), plan(s, d).where("chunk_id <> 'c001'")),
    "rendered_table": lambda s, d: docs(s, d).select("doc_id", F.sha2(C.rendered_table(F.concat(F.lit("<table border=1><tr><td>a & `b`</td><td>"), "text", F.lit("</td></tr></table>"))), 256).alias("digest")),
    "anchors": lambda s, d: C.anchors(lines_of(s, d).select(F.col("doc_id").alias("part"), (-F.col("i")).alias("ord"))),
    "own_titles": lambda s, d: C.without_own_titles(titled_blocks(s, d), docs(s, d).select(F.col("doc_id").alias("part"), F.lit("T").alias("title"), F.lit(3).alias("number"), F.lit(None).cast("array<string>").alias("strip"))).select("part", "ord"),
    "special_lines": lambda s, d: C.special_lines(docs(s, d).select(F.col("doc_id").alias("part"), F.lit(0).alias("ord"), F.element_at(F.array(F.lit("title"), F.lit("toc"), F.lit("index")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"), F.concat(F.lit("第 2 章 a <b> ... "), F.col("doc_id")).alias("line"))),
    "content_segments": lambda s, d: J.content_segments(content_lists(s, d)).select("bundle", "ord", "segment_id", "page_idx", "kind", F.sha2("text", 256).alias("digest"), F.round("score", 9).alias("score"), "source"),
    "parsed_pages": lambda s, d: J.parsed_page_count(results(s, d)),
    "seam_look": lambda s, d: P.seam_texts(seam_pages(s, d), pages(s, d)).select("book_id", "left_page", "right_page", "tail", "head", "look"),
    "work_pages": lambda s, d: P.work_pages(low_pages(s, d), seam_pages(s, d), P.books(pages(s, d))),
    "paged_pieces": lambda s, d: marked(s, d).select("book_id", "page_no", F.sha2("piece", 256).alias("digest")),
    "paged_markdown": lambda s, d: P.pages_of_markdown(marked(s, d).select("book_id", F.concat(F.lit("preface\n"), "piece", F.lit("\n"), "piece").alias("markdown"))).select("book_id", "page_no", "chunk_id", F.sha2("text", 256).alias("digest")),
    "fixed_split": lambda s, d: P.fixed_split(P.books(pages(s, d)), 7),
    "pending_chunks": lambda s, d: P.pending(plan(s, d), plan(s, d).where("chunk_id <> 'c002'")).select("book_id", "chunk_id"),
    "checker_lines": lambda s, d: I.checker_lines(reports(s, d)),
    "checker_messages": lambda s, d: I.checker_messages(messages(s, d)),
    "newest_alerts": lambda s, d: S.noticed(alerts(s, d), "error", 20).select("alert_id", "code", "severity"),
    "last_severity": lambda s, d: S.last_severity(alerts(s, d)),
    "known_states": lambda s, d: S.known_states(states(s, d), "run_id: string, stage: string"),
    "stages_to_run": lambda s, d: S.to_run(stages(s, d), 2),
    "changed_sources": lambda s, d: S.stale(docs(s, d).select(F.col("doc_id").alias("name"), F.col("text").alias("content")), docs(s, d).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("name"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("digest"))).select("name", "status"),
    "local_time": lambda s, d: docs(s, d).select("doc_id", S.local_time(F.col("doc_id") * 86_399 + 1_700_000_000).alias("at"), S.duration(F.lit(1.0), F.col("doc_id") / 7.0).alias("seconds")),
    "bare_amp": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(M.bare_amp_escaped(F.concat("html", F.lit("&x;&#7;& y&&z;"))), 256).alias("digest")),
    "unescaped": lambda s, d: docs(s, d).select("doc_id", F.sha2(M.unescaped(F.concat(F.lit("&lt;&#65;&#x42;&times;&amp;"), "text")), 256).alias("digest")),
    "inline_kept": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(M.escaped_but_inline(F.concat("html", F.lit("<sub>x</sub> & <em>y"))), 256).alias("digest")),
    "asm_math": lambda s, d: docs(s, d).select("doc_id", M.is_asm_math(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("; \\#5")).when(F.col("doc_id") % 3 == 1, F.lit("0xF")).otherwise(F.lit("x")))).alias("is_code")),
    "table_attributes": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(M.table_attributes(F.concat(F.lit("<table border=1 width=79%>\\n"), "html")), 256).alias("digest")),
    "issue_path": lambda s, d: table(s, d, "pages").select("page_id", M.issue_path(F.concat(F.lit("\\x\\"), F.when(F.col("page_id") % 2 == 0, F.lit("b.epub/OEBPS/")).otherwise(F.lit("")), "url")).alias("path")),
    "simple_level": lambda s, d: docs(s, d).select("doc_id", M.simple_level(F.concat(F.lit(" "), F.col("doc_id") % 7, F.when(F.col("doc_id") % 2 == 0, F.lit(".3.1")).otherwise(F.lit("")), F.lit(" "), "text")).alias("level")),
    "chapter_starts": lambda s, d: lines_of(s, d).select("doc_id", "i", M.is_chapter_start(F.concat(F.lit("## "), F.when(F.col("doc_id") % 3 == 0, F.lit("2.1 ")).when(F.col("doc_id") % 3 == 1, F.lit("4 ")).otherwise(F.lit("")), "line")).alias("starts")),
    "labels_of_language": lambda s, d: table(s, d, "documents").select("doc_id", M.label(F.when(F.col("doc_id") % 2 == 0, F.lit("ZH-tw")).otherwise(F.col("lang")), "toc").alias("toc")),
    "context": lambda s, d: docs(s, d).select("doc_id", M.context(F.col("text"), F.col("doc_id") % 100).alias("around")),
    "page_orders": lambda s, d: docs(s, d).select("doc_id", F.explode(M.page_orders(F.concat(F.col("doc_id"), F.lit(":2，7 x 9:")))).alias("o")).select("doc_id", "o.page", "o.ord"),
    "written_chapters": lambda s, d: docs(s, d).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 4 == 0, F.lit(M.SAMPLE_MARKER)).otherwise(F.lit(""))).alias("text")).where(M.is_written(F.col("text"))).select("doc_id"),
    "large_tables": lambda s, d: H.inventory(counted_tables(s, d)).select("page_no", "ord", "rows", "cols", "needs_image"),
    "cache_upsert": lambda s, d: R.upserted(docs(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("key"), F.lit("old").alias("translated")), docs(s, d).where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), F.lit("new").alias("translated"))),
    "stream_findings": flagged_stream,
}

_LAST = f"seam AS (SELECT book_id, page_end + 1 AS left_page, lead(page_start) OVER (PARTITION BY book_id ORDER BY page_start) + 1 AS right_page FROM cp QUALIFY right_page IS NOT NULL), fl AS (SELECT book_id, page_no, regexp_replace({us('text')}, '\\s+', ' ', 'g') AS t FROM bp)"
_MARK = f"SELECT book_id, page_no, format('c{{:03d}}', page_no % 7) AS chunk_id, '<!-- ===== 原书第 ' || page_no || ' 页（' || format('c{{:03d}}', page_no % 7) || '）===== -->' || chr(10) || chr(10) || {us('text')} || chr(10) AS piece, {us('text')} AS body FROM bp"
_STAGES = "(VALUES (0, 'prepare'), (1, 'calibrate'), (2, 'compose'), (3, 'check'))"
_PAT = lambda name, p: f"SELECT {quoted(name)} AS detector, url AS book_id, page_id AS page_no, len(regexp_extract_all(html, {quoted(p)})) AS n, regexp_extract(html, {quoted(p)}) AS evidence FROM pages WHERE regexp_matches(html, {quoted(p)})"
# The same rules, written from their description and not from the constants of the code.
SQL = {
    "report_lines": "WITH i AS (SELECT 'R-' || doc_id % 3 AS id, CASE WHEN doc_id % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, source AS message, doc_id::VARCHAR AS path, doc_id % 4 AS line FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY id, path, line, message) AS nth, count(*) OVER (PARTITION BY severity) AS c FROM i) SELECT severity, nth AS ord, '- [' || id || '] ' || message || ' (' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END || ')' AS line FROM r WHERE nth <= 5 UNION ALL SELECT DISTINCT severity, 0, '## ' || severity || ': ' || c FROM r UNION ALL SELECT DISTINCT severity, 6, '- and ' || (c - 5) || ' more' FROM r WHERE c > 5",
    "counts_json": "SELECT '{' || string_agg('\"' || id || '\":' || n, ',' ORDER BY id) || '}' AS counts FROM (SELECT 'R-' || doc_id % 3 AS id, count(*) AS n FROM documents GROUP BY 1)",
    "book_records": "SELECT doc_id AS file, 'T ' || doc_id AS title, doc_id::VARCHAR AS author, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'zh' END AS language, 'c.png' AS cover, 'a.xhtml|b/c.xhtml' AS spine FROM documents WHERE doc_id % 7 <> 0",
    "repeated_targets": "SELECT * FROM (SELECT lang AS book_id, doc_id AS ord, source AS href, min(doc_id) OVER (PARTITION BY lang, source) AS first FROM documents) WHERE ord > first",
    "well_formed_seams": "SELECT doc_id AS book_id, 1 AS idx, doc_id AS left_page, doc_id + 1 AS right_page FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2, NULL, NULL FROM documents WHERE doc_id % 3 <> 0",
    "bundle_order": f"WITH {CP}, f AS (SELECT book_id, chunk_id AS bundle FROM cp UNION ALL SELECT 'x' || doc_id % 5, doc_id::VARCHAR FROM documents), p AS (SELECT * FROM cp WHERE chunk_id <> 'c001') SELECT f.book_id, f.bundle, row_number() OVER (PARTITION BY f.book_id ORDER BY p.page_start NULLS FIRST, f.bundle) AS pos FROM f LEFT JOIN p ON p.book_id = f.book_id AND p.chunk_id = f.bundle WHERE p.chunk_id IS NOT NULL OR f.book_id NOT IN (SELECT book_id FROM p)",
    "rendered_table": "WITH t AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS c, len(regexp_extract_all(text, '\\$')) AS n FROM documents) SELECT doc_id, sha256('<table border=\"1\"><tr><td>a &amp; <code>b</code></td><td>' || CASE WHEN n % 2 = 0 THEN regexp_replace(regexp_replace(c, '`([^`]+)`', '<code>\\1</code>', 'g'), '\\$([^$]+)\\$', '<code class=\"math\">\\1</code>', 'g') ELSE regexp_replace(c, '`([^`]+)`', '<code>\\1</code>', 'g') END || '</td></tr></table>') AS digest FROM t",
    "anchors": "SELECT doc_id AS part, 1 - i AS ord, 's-' || (len(l) - i + 1) AS anchor FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "own_titles": "SELECT doc_id AS part, unnest(CASE WHEN doc_id % 2 = 0 THEN [3] ELSE [1, 2, 3] END) AS ord FROM documents",
    "special_lines": "SELECT doc_id AS part, 0 AS ord, CASE doc_id % 3 WHEN 0 THEN '<p class=\"title-line\">第 2 章 a &lt;b&gt; ... ' || doc_id || '</p>' WHEN 1 THEN '<p class=\"toc-item toc-chapter\">第 2 章 a &lt;b&gt; <span class=\"toc-page\">' || doc_id || '</span></p>' ELSE '<p class=\"index-line\">第 2 章 a &lt;b&gt; ... ' || doc_id || '</p>' END AS html FROM documents",
    "content_segments": f"SELECT doc_id AS bundle, 0 AS ord, 'S00001' AS segment_id, doc_id - 1 AS page_idx, 'title' AS kind, sha256(CASE WHEN {us('text')} = '' THEN 'c' ELSE {us('text')} || chr(10) || 'c' END) AS digest, round(CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 130 <= 1 THEN (doc_id % 130)::DOUBLE WHEN doc_id % 130 <= 100 THEN (doc_id % 130) / 100 END WHEN 1 THEN doc_id % 100 / 100 END, 9) AS score, CASE WHEN doc_id % 3 = 0 AND doc_id % 130 <= 100 THEN 'score' WHEN doc_id % 3 = 1 THEN 'meta.conf' ELSE 'none' END AS source FROM documents",
    "parsed_pages": "SELECT doc_id AS bundle, CASE doc_id % 4 WHEN 0 THEN greatest(doc_id, 2) + 1 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS parsed_pages FROM documents",
    "seam_look": f"WITH {CP}, {_LAST}, j AS (SELECT s.*, coalesce(right(l.t, 160), '') AS tail, coalesce(left(r.t, 160), '') AS head FROM seam s LEFT JOIN fl l ON l.book_id = s.book_id AND l.page_no = left_page LEFT JOIN fl r ON r.book_id = s.book_id AND r.page_no = right_page) SELECT *, CASE WHEN regexp_matches(head, '^\\s*(#|【|例|图|表|注|解|分析|证明|题型|习题|第\\s*\\d+\\s*[章节讲]|<!--)') THEN 'block' WHEN tail <> '' AND contains('。！？…；;!?：:', right(tail, 1)) THEN 'sentence' ELSE 'suspicious' END AS look FROM j",
    "work_pages": f"WITH {CP}, {_LAST}, low AS (SELECT book_id, page_no FROM bp JOIN labels USING (doc_id) WHERE quality = 0), near AS (SELECT book_id, p AS page_no, false AS is_seam FROM (SELECT book_id, unnest(range(page_no - 1, page_no + 2)) AS p FROM low) JOIN bk USING (book_id) WHERE p BETWEEN 1 AND page_count) SELECT book_id, page_no, bool_or(is_seam) AS is_seam FROM (SELECT * FROM near UNION ALL SELECT book_id, left_page, true FROM seam UNION ALL SELECT book_id, right_page, true FROM seam) GROUP BY 1, 2",
    "paged_pieces": f"WITH {BP}, m AS ({_MARK}) SELECT book_id, page_no, sha256(piece) AS digest FROM m",
    "paged_markdown": f"WITH {BP}, m AS ({_MARK}) SELECT book_id, page_no, chunk_id, sha256(body) AS digest FROM m UNION ALL SELECT book_id, page_no, chunk_id, sha256(body) FROM m",
    "fixed_split": f"WITH {BK} SELECT book_id, p AS page_start, least(page_count, p + 6) AS page_end FROM (SELECT book_id, page_count, unnest(range(1, page_count + 1, 7)) AS p FROM bk)",
    "pending_chunks": f"WITH {CP} SELECT book_id, chunk_id FROM cp WHERE chunk_id = 'c002'",
    "checker_lines": "SELECT 'RSC-005' AS id, 'ERROR' AS severity, left(source, 9) || ' is: wrong' AS message, 'en/' || doc_id || '.xhtml' AS path, doc_id % 50 AS line, 7 AS col FROM documents UNION ALL SELECT 'OPF-003', 'WARNING', 'twice', 'OEBPS/p.opf', 0, 0 FROM documents UNION ALL SELECT 'CHK-1', 'INFO', 'done', '', 0, 0 FROM documents",
    "checker_messages": "SELECT 'RSC-007' AS id, 'ERROR' AS severity, source AS message, '' AS path, 0 AS line, 0 AS col FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'RSC-007', 'ERROR', source, 'a.xhtml', doc_id % 9, 3 FROM documents WHERE doc_id % 3 >= 1 UNION ALL SELECT 'RSC-007', 'ERROR', source, 'b.xhtml', 1, 1 FROM documents WHERE doc_id % 3 = 2",
    "newest_alerts": "SELECT event_id AS alert_id, event_type AS code, 'ERROR' AS severity FROM events WHERE event_id % 4 = 2 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "last_severity": "SELECT event_type AS code, ['INFO', 'WARNING', 'ERROR', 'CRITICAL'][arg_max(event_id, (ts, event_id)) % 4 + 1] AS severity FROM events GROUP BY 1",
    "known_states": "SELECT doc_id AS file, 'r' || doc_id AS run_id, source AS stage FROM documents WHERE doc_id % 5 <> 0",
    "stages_to_run": f"SELECT doc_id AS run_id, stage, ord FROM documents, {_STAGES} t(ord, stage) WHERE doc_id % 5 <= 3 AND ord >= doc_id % 5 AND ord <= 2",
    "changed_sources": "SELECT doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 3 = 0 AND upper(text) <> text THEN 'changed' ELSE 'same' END AS status FROM documents",
    "local_time": "SELECT doc_id, strftime(make_timestamp((doc_id * 86399 + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, round(doc_id / 7.0::DOUBLE - 1, 3) AS seconds FROM documents",
    "bare_amp": "SELECT page_id, sha256(array_to_string(list_transform(regexp_extract_all(html || '&x;&#7;& y&&z;', '&#?[0-9A-Za-z_]+;|&|[^&]+'), lambda x: CASE WHEN x = '&' THEN '&amp;' ELSE x END), '')) AS digest FROM pages",
    "unescaped": "SELECT doc_id, sha256('<AB\\times&' || text) AS digest FROM documents",
    "inline_kept": "SELECT page_id, sha256(array_to_string(list_transform(regexp_extract_all(html || '<sub>x</sub> & <em>y', '(?s)</?(?:sup|sub|em|strong)>|<br\\s*/?>|<|[^<]+'), lambda x: CASE WHEN regexp_matches(x, '^(</?(sup|sub|em|strong)>|<br\\s*/?>)$') THEN x ELSE replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END), '')) AS digest FROM pages",
    "asm_math": "SELECT doc_id, doc_id % 3 <= 1 OR contains(text, '//') OR regexp_matches(text, '\\b(assign|endcase|case|casez)\\b|1''b[01x]|0x[0-9a-fA-F]') OR (contains(text, ';') AND regexp_matches(text, '\\\\#|\\\\\\\\')) AS is_code FROM documents",
    "table_attributes": "SELECT page_id, sha256('<table border=\"1\" width=\"79%\"><br/>' || replace(html, '\\n', '<br/>')) AS digest FROM pages",
    "issue_path": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'OEBPS/' || replace(url, '\\', '/') ELSE 'x/' || replace(url, '\\', '/') END AS path FROM pages",
    "simple_level": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS level FROM documents",
    "chapter_starts": "SELECT doc_id, i - 1 AS i, CASE WHEN doc_id % 3 = 1 THEN true WHEN doc_id % 3 = 0 THEN NOT regexp_matches(l[i], '\\S') ELSE regexp_matches(l[i], '\\S') AND NOT regexp_matches(l[i], '^\\s*\\d+(\\.\\d+)+\\s+\\S') END AS starts FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "labels_of_language": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR lang IS NULL OR lang = '' OR starts_with(lower(lang), 'zh') THEN '目录' ELSE 'Contents' END AS toc FROM documents",
    "context": "SELECT doc_id, replace(substring(text, greatest(0, doc_id % 100 - 28) + 1, least(length(text), doc_id % 100 + 28) - greatest(0, doc_id % 100 - 28)), chr(10), ' ') AS around FROM documents",
    "page_orders": "SELECT doc_id, unnest([doc_id, 7, 9]) AS page, unnest([2, 1, 1]) AS ord FROM documents",
    "written_chapters": "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0",
    "large_tables": "SELECT doc_id AS page_no, 1 AS ord, doc_id % 20 + 1 AS rows, doc_id % 9 + 1 AS cols, doc_id % 9 + 1 >= 9 OR (doc_id % 9 + 1 >= 6 AND doc_id % 20 + 1 >= 15) OR (doc_id % 20 + 1) * (doc_id % 9 + 1) >= 150 AS needs_image FROM documents",
    "cache_upsert": "SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS translated FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "stream_findings": " UNION ALL ".join(_PAT(*x) for x in (("double_amp", "&amp;&amp;"), ("broken_glyph", "[\\x{25a1}\\x{fffd}]"), ("isolated_o", "[\\x{4e00}-\\x{9fff}]\\s+o\\s+[\\x{4e00}-\\x{9fff}]"))),
}
