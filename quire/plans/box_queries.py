"""Queries on boxes, tables, documents of a package, issues, alerts and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import geometry as G
from quire.operators import lint as I
from quire.operators import package as K
from quire.operators import segments as J
from quire.operators import state as S
from quire.operators import tables as H
from quire.plans.common import docs, quoted, table, us
from quire.streaming import folds

def boxes(s, d):
    """Boxes made of the first numbers of vectors: (vec_id, page, box, score)."""
    v = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    box = F.struct(F.least(v(0), v(1)).alias("x0"), F.least(v(2), v(3)).alias("y0"), F.greatest(v(0), v(1)).alias("x1"), F.greatest(v(2), v(3)).alias("y1"))
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("page"), box.alias("box"), v(4).alias("score"))


def layout(s, d):
    b = boxes(s, d)
    targets = b.where("vec_id % 2 = 0").select(F.col("vec_id").alias("target_id"), "page", "box")
    return G.layout_scores(targets, b.where("vec_id % 2 = 1").select("page", "box", "score", F.concat(F.lit("b"), "vec_id").alias("source")))


def pairs(s, d):
    b = boxes(s, d)
    other = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("box").alias("other"))
    return b.join(other, "vec_id")


def issues(s, d):
    """Issues by documents: bad labels are errors, toxic ones warnings."""
    severity = F.when(F.col("quality") == 0, "ERROR").when(F.col("toxic") == 1, "WARNING").otherwise("INFO")
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(F.concat(F.lit("DOC-"), F.col("doc_id") % 3).alias("id"), severity.alias("severity"), F.col("source").alias("path"), (F.col("doc_id") % 5 + 1).cast("int").alias("line"), "doc_id")


def alerts(s, d):
    level = F.when(F.col("value") > 150, "ERROR").when(F.col("value") > 100, "WARNING").otherwise("INFO")
    return table(s, d, "events").select(F.col("event_type").alias("code"), F.col("props").alias("message"), level.alias("severity"), "ts", F.col("event_id").alias("alert_id"))


def stages(s, d):
    done = F.when(F.max("value") > 120, "DONE").otherwise("RUNNING")
    order = F.dense_rank().over(Window.orderBy("stage"))
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")).agg(done.alias("status"))
    types = rows.select("stage").distinct().select("stage", order.alias("ord"))
    return rows.join(F.broadcast(types), "stage")


def xhtml(s, d):
    return table(s, d, "pages").select(F.lit("book").alias("epub"), F.concat(F.lit("en/"), "page_id", F.lit(".xhtml")).alias("name"), F.col("html").alias("text"), "page_id")


def missing_refs(s, d):
    found = I.reference_issues(xhtml(s, d), xhtml(s, d).select("epub", "name"))
    return found.groupBy("id", "path").agg(F.count("*").alias("n"))


def structure(s, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)) != ""
    return table(s, d, "pages").select("page_id", title.alias("has_title"), count("<h1[ >]").alias("n_h1"), (count("<p[ >]") - count("</p>")).alias("open_p"), (count("<body[ >]") > 0).alias("has_body"))


def repeated_links(s, d):
    """Targets that a document links to more than once."""
    ids = table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("name"))
    return ids.groupBy("page_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def with_ids(s, d):
    """A well-formed document for each text, whose words are the ids of its elements."""
    word = lambda w: F.concat(F.lit('<p id="'), w, F.lit('"/>'))
    body = F.array_join(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), word), "")
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>'), body, F.lit("</body></html>"))
    return docs(s, d).select(F.concat("doc_id", F.lit(".xhtml")).alias("name"), F.encode(page, "UTF-8").alias("content"))


def duplicate_ids(s, d):
    found = I.document_issues(with_ids(s, d)).where("id = 'RSC-005'")
    return found.select("path", F.substring_index("message", ": ", -1).alias("name"), "severity")


def files(s, d):
    return table(s, d, "pages").select(F.concat(F.lit("b"), F.col("page_id") % 7).alias("book_id"), F.concat(F.lit("t/"), "page_id", F.element_at(F.array(F.lit(".xhtml"), F.lit(".png"), F.lit(".dat")), (F.col("page_id") % 3 + 1).cast("int"))).alias("href"), F.col("html").alias("text"), "page_id")


def spine(s, d):
    return files(s, d).where("page_id % 2 = 0").select("book_id", (-F.col("page_id")).alias("ord"), "href")


def streamed(s, d, fold, mode, name="events"):
    import os
    import tempfile

    batch = table(s, d, name)
    shared = s.conf.get("spark.checkpoint.dir", None)
    if not shared and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or tempfile.mkdtemp(prefix="quire-")
    checkpoint = f"{shared.rstrip('/')}/stream-{os.urandom(8).hex()}"
    return folds.finished(fold(folds.events(s, f"{d}/{name}.parquet*", batch.schema)), mode, checkpoint)


def table_pages(s, d):
    """Pages of 16 orders' tables, a row of a table for each line item: small ones, one for each order, or one for all; with captions and other
    text before them; as many cells as the part's number says, in some orders the same in all rows."""
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    page = F.floor(order / 16)
    key = F.when(page % 3 == 0, page * 16).otherwise(order)
    cells = F.when(order % 5 < 2, order % 10 + 1).otherwise(part % 4 + order % 7 + 1).cast("int")
    row = F.concat(F.lit("<tr>"), F.expr("repeat(concat('<td>', l_partkey, '</td>'), cells)"), F.lit("</tr>"))
    rows = table(s, d, "lineitem").withColumn("cells", cells).select(page.alias("page_no"), key.alias("t"), F.struct(order.alias("o"), F.col("l_linenumber").alias("l"), part.alias("p"), supp.alias("s"), row.alias("row")).alias("r"))
    tables = rows.groupBy("page_no", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "").alias("rows"))
    before = F.when(F.col("t") % 2 == 0, F.concat(F.lit("表 "), F.col("t"), F.lit("-1 数据\n"))).otherwise("x ")
    one = tables.select("page_no", F.struct("t", F.concat(before, F.lit("<table>"), "rows", F.lit("</table>")).alias("text")).alias("x"))
    return one.groupBy("page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), " ").alias("text"))


def json_nodes(s, d):
    value = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("page_idx"), F.array(F.struct(F.lit("Text").alias("type"), F.col("text"), (F.col("doc_id") % 130).alias("Confidence"))).alias("blocks"))).alias("pages")))
    found = J.scored_nodes(docs(s, d).select(F.col("doc_id").alias("doc"), value.alias("value")))
    return found.select("doc", "path", "page_idx", "kind", F.sha2("text", 256).alias("digest"), "score", "source")


QUERIES = {
    "layout_score": layout,
    "overlap": lambda s, d: pairs(s, d).select("vec_id", F.round(G.intersection(F.col("box"), F.col("other")), 9).alias("common"), F.round(G.iou(F.col("box"), F.col("other")), 9).alias("iou")),
    "bbox": lambda s, d: table(s, d, "embeddings").select("vec_id", G.bbox(F.slice("embedding", 1, F.when(F.col("vec_id") % 3 == 0, 4).when(F.col("vec_id") % 3 == 1, 8).otherwise(5))).alias("b")).select("vec_id", "b.*"),
    "coord_system": lambda s, d: G.coordinate_systems(boxes(s, d).select((F.col("page") % 4).alias("bundle"), F.transform(F.array("box.x0", "box.y0", "box.x1", "box.y1"), lambda v: v * F.pow(F.lit(30.0), F.col("page") % 4)).alias("v"), F.lit(500.0).alias("width"), F.lit(800.0).alias("height")).select("bundle", G.bbox(F.col("v")).alias("box"), "width", "height")),
    "score_norm": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.score_norm(F.col("l_quantity") * 3).alias("score")),
    "low_confidence": lambda s, d: G.low_confidence(boxes(s, d).select(F.col("page").alias("page_idx"), F.col("vec_id").alias("ord"), "score"), 0.1),
    "crop_box": lambda s, d: boxes(s, d).select("vec_id", G.crop_box(F.col("box"), 1000, 1400).alias("c")).select("vec_id", "c.*"),
    "table_inventory": lambda s, d: H.inventory(table_pages(s, d)),
    "needs_image": lambda s, d: H.inventory(table_pages(s, d)).where("needs_image").select("page_no", "ord", "cols", "rows"),
    "over_limit": lambda s, d: H.over_limit(H.inventory(table_pages(s, d))).select("page_no", "ord", "cols", "rows", "chars"),
    "table_ragged": lambda s, d: H.inventory(table_pages(s, d)).where("ragged <> ''").select("page_no", "ord", "ragged"),
    "html_structure": structure,
    "html_links": lambda s, d: I.references(xhtml(s, d)).groupBy("name", "href").agg(F.count("*").alias("n")),
    "missing_refs": missing_refs,
    "duplicate_ids": duplicate_ids,
    "repeated_links": repeated_links,
    "fix_img": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(K.fixed_images(F.concat("html", F.lit('<img src="images/a.png" width="79%" alt="">'))), 256).alias("digest")),
    "media_types": lambda s, d: files(s, d).select("href", K.media_type(F.col("href")).alias("media_type")),
    "manifest": lambda s, d: K.manifest(files(s, d)).select("book_id", "href", "media_type", "item_id", "properties"),
    "spine_order": lambda s, d: K.spine_order(spine(s, d), K.manifest(files(s, d))),
    "spine_warnings": lambda s, d: K.spine_warnings(spine(s, d), K.manifest(files(s, d))),
    "document_lint": lambda s, d: I.document_issues(xhtml(s, d).select("name", F.encode("text", "UTF-8").alias("content"))).groupBy("id", "severity").agg(F.count("*").alias("n")),
    "issue_counts": lambda s, d: I.issue_counts(issues(s, d)),
    "issue_report": lambda s, d: issues(s, d).select("doc_id", I.severity_rank(F.col("severity")).alias("rank"), "path", "line").where("rank < 3"),
    "issue_excerpt": lambda s, d: I.excerpts(issues(s, d).where("severity = 'ERROR'").select(F.col("doc_id").cast("string").alias("path"), "line"), docs(s, d).select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")).select("path", "line", "at_line", "mark", F.sha2("text", 256).alias("digest")),
    "severity_gate": lambda s, d: I.gate(issues(s, d)),
    "top_per_group": lambda s, d: I.top_per_group(issues(s, d).select("path", "id", "doc_id"), "path", ["id", "doc_id"], 6),
    "exit_code": lambda s, d: S.exit_code(alerts(s, d)),
    "alert_fold": lambda s, d: S.folded_alerts(alerts(s, d)),
    "first_incomplete": lambda s, d: S.first_incomplete(stages(s, d)),
    "json_segments": json_nodes,
    "stream_alert_fold": lambda s, d: streamed(s, d, folds.alert_fold, "complete"),
    "stream_latest_state": lambda s, d: streamed(s, d, folds.latest_state, "complete"),
}

_BOX = "bx AS (SELECT vec_id, label AS page, least(a, b) AS x0, least(c, e) AS y0, greatest(a, b) AS x1, greatest(c, e) AS y1, score FROM (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS a, abs(embedding[2]::DOUBLE) AS b, abs(embedding[3]::DOUBLE) AS c, abs(embedding[4]::DOUBLE) AS e, abs(embedding[5]::DOUBLE) AS score FROM embeddings))"
_INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = lambda t: f"(greatest(0, {t}.x1 - {t}.x0) * greatest(0, {t}.y1 - {t}.y0))"
_ISSUES = "iss AS (SELECT 'DOC-' || (doc_id % 3) AS id, CASE WHEN quality = 0 THEN 'ERROR' WHEN toxic = 1 THEN 'WARNING' ELSE 'INFO' END AS severity, source AS path, doc_id % 5 + 1 AS line, doc_id FROM labels JOIN documents USING (doc_id))"
_FILES = "fl AS (SELECT 'b' || (page_id % 7) AS book_id, 't/' || page_id || (['.xhtml', '.png', '.dat'])[page_id % 3 + 1] AS href, page_id, html FROM pages), mf AS (SELECT book_id, href, CASE WHEN ends_with(href, 'png') THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type, page_id, html FROM fl WHERE NOT ends_with(href, 'dat')), sp AS (SELECT book_id, -page_id AS ord, href FROM fl WHERE page_id % 2 = 0)"
_LEVEL = "CASE WHEN value > 150 THEN 'ERROR' WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END"
_REFS = "rf AS (SELECT 'en/' || page_id || '.xhtml' AS name, unnest(list_concat(regexp_extract_all(html, '(?i)\\ssrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), regexp_extract_all(html, '(?i)\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))) AS href FROM pages)"
_TABLES = "ti0 AS (SELECT l_orderkey // 16 AS page_no, CASE WHEN (l_orderkey // 16) % 3 = 0 THEN l_orderkey // 16 * 16 ELSE l_orderkey END AS t, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, '<tr>' || repeat('<td>' || l_partkey || '</td>', (CASE WHEN l_orderkey % 5 < 2 THEN l_orderkey % 10 + 1 ELSE l_partkey % 4 + l_orderkey % 7 + 1 END)::INT) || '</tr>' AS row FROM lineitem), tb AS (SELECT page_no, t, CASE WHEN t % 2 = 0 THEN '表 ' || t || '-1 数据' || chr(10) ELSE 'x ' END || '<table>' || string_agg(row, '' ORDER BY o, l, p, s) || '</table>' AS text FROM ti0 GROUP BY 1, 2), tp AS (SELECT page_no, string_agg(text, ' ' ORDER BY t) AS text FROM tb GROUP BY 1)"
_INV = f"{_TABLES}, tt AS (SELECT page_no, text, regexp_extract_all(text, '(?s)<table.*?</table>') AS h, string_split_regex(text, '(?s)<table.*?</table>') AS bt FROM tp), ti AS (SELECT page_no, i AS ord, h[i] AS html, right(bt[i], 200) AS before FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM tt)), tc AS (SELECT *, list_transform(regexp_extract_all(html, '(?s)<tr.*?</tr>'), lambda r: len(regexp_extract_all(r, '(?s)<td.*?</td>'))) AS cells FROM ti), inv AS (SELECT page_no, ord, len(cells) AS rows, coalesce(list_max(cells), 0) AS cols, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars, array_to_string(list_sort(list_distinct(list_filter(cells, lambda c: c <> list_max(cells) AND c > 1))), ',') AS ragged, coalesce(trim(regexp_extract_all(before, '(表\\s*[\\dA-Za-z.\\-]+[^\\n<]{{0,60}})', 1)[-1]), '') AS caption, (coalesce(list_max(cells), 0) >= 9 OR (coalesce(list_max(cells), 0) >= 6 AND len(cells) >= 15) OR coalesce(list_max(cells), 0) * len(cells) >= 150) AS needs_image, length(regexp_replace(html, '<[^>]+>', '', 'g')) > 1200 AS too_long FROM tc)"

SQL = {
    "layout_score": f"WITH {_BOX}, h AS (SELECT a.vec_id AS target_id, b.score, 'b' || b.vec_id AS source FROM bx a JOIN bx b ON a.page = b.page AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {_INTER} > 0 AND (({_INTER} >= 0.5::DOUBLE * {_AREA('a')} AND {_AREA('a')} > 0) OR {_INTER} >= 0.5::DOUBLE * greatest({_AREA('b')}, 1e-9::DOUBLE))) SELECT target_id, min(score) AS score, 'layout:' || arg_min(source, score) AS source, count(*) AS hits FROM h GROUP BY 1",
    "overlap": f"WITH {_BOX}, p AS (SELECT a.vec_id, {_INTER} AS c, {_AREA('a')} + {_AREA('b')} AS s FROM bx a JOIN bx b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(c, 9) AS common, round(CASE WHEN s - c > 0 THEN c / (s - c) ELSE 0 END, 9) AS iou FROM p",
    "bbox": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN v[1] WHEN 1 THEN least(v[1], v[3], v[5], v[7]) END AS x0, CASE vec_id % 3 WHEN 0 THEN v[2] WHEN 1 THEN least(v[2], v[4], v[6], v[8]) END AS y0, CASE vec_id % 3 WHEN 0 THEN v[3] WHEN 1 THEN greatest(v[1], v[3], v[5], v[7]) END AS x1, CASE vec_id % 3 WHEN 0 THEN v[4] WHEN 1 THEN greatest(v[2], v[4], v[6], v[8]) END AS y1 FROM e",
    "coord_system": f"WITH {_BOX}, f AS (SELECT page % 4 AS bundle, greatest(x0, y0, x1, y1) * pow(30.0, page % 4) AS top, greatest(greatest(x0, x1) * pow(30.0, page % 4) / 500, greatest(y0, y1) * pow(30.0, page % 4) / 800) AS scaled FROM bx) SELECT bundle, CASE WHEN max(top) <= 1.5 THEN 'unit' WHEN max(scaled) <= 1.05 THEN 'pixels' WHEN max(top) <= 1000 THEN 'thousand' END AS system FROM f GROUP BY 1",
    "score_norm": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 3 BETWEEN 0 AND 1 THEN l_quantity * 3 WHEN l_quantity * 3 > 1 AND l_quantity * 3 <= 100 THEN l_quantity * 3 / 100 END AS score FROM lineitem",
    "low_confidence": f"WITH {_BOX} SELECT page AS page_idx, vec_id AS ord, score FROM bx WHERE score < 0.1 ORDER BY score, page, vec_id LIMIT 200",
    "crop_box": f'WITH {_BOX} SELECT vec_id, greatest(0, floor(x0 * 1000) - 10)::INT AS "left", greatest(0, floor(y0 * 1400) - 10)::INT AS top, least(1000, ceil(x1 * 1000) + 10)::INT AS "right", least(1400, ceil(y1 * 1400) + 10)::INT AS bottom FROM bx',
    "table_inventory": f"WITH {_INV} SELECT * FROM inv",
    "needs_image": f"WITH {_INV} SELECT page_no, ord, cols, rows FROM inv WHERE needs_image",
    "over_limit": f"WITH {_INV} SELECT page_no, ord, cols, rows, chars FROM inv WHERE needs_image OR too_long",
    "table_ragged": f"WITH {_INV} SELECT page_no, ord, ragged FROM inv WHERE ragged <> ''",
    "html_structure": "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) <> '' AS has_title, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '<p[ >]')) - len(regexp_extract_all(html, '</p>')) AS open_p, regexp_matches(html, '<body[ >]') AS has_body FROM pages",
    "html_links": f"WITH {_REFS} SELECT name, href, count(*) AS n FROM rf WHERE href <> '' GROUP BY 1, 2",
    "missing_refs": f"WITH {_REFS}, g AS (SELECT name, href, regexp_matches(href, {quoted(I.REMOTE)}) AS remote, regexp_replace(href, '[?#].*$', '') AS c FROM rf WHERE href <> '') SELECT CASE WHEN remote THEN 'RSC-006' ELSE 'RSC-007' END AS id, name AS path, count(*) AS n FROM g WHERE remote OR (NOT regexp_matches(href, '^(mailto|tel):') AND NOT starts_with(href, '#') AND ltrim(c, '/') NOT IN (SELECT 'en/' || page_id || '.xhtml' FROM pages)) GROUP BY 1, 2",
    "duplicate_ids": "SELECT doc_id || '.xhtml' AS path, name, 'ERROR' AS severity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents) GROUP BY doc_id, name HAVING count(*) > 1",
    "repeated_links": "SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS name FROM pages) GROUP BY 1, 2 HAVING count(*) > 1",
    "fix_img": "SELECT page_id, sha256(regexp_replace(replace(html || '<img src=\"images/a.png\" width=\"79%\" alt=\"\">', 'src=\"images/', 'src=\"../images/'), '\\swidth=\"(\\d+(?:\\.\\d+)?)%\"', ' style=\"width:\\1%\"', 'g')) AS digest FROM pages",
    "media_types": f"WITH {_FILES} SELECT fl.href, media_type FROM fl LEFT JOIN mf USING (href)",
    "manifest": f"WITH {_FILES} SELECT book_id, href, media_type, 'i-' || page_id AS item_id, CASE WHEN media_type = 'application/xhtml+xml' AND regexp_matches(html, '<math[\\s>]|1998/Math/MathML') THEN 'mathml' ELSE '' END AS properties FROM mf",
    "spine_order": f"WITH {_FILES} SELECT mf.book_id, row_number() OVER (PARTITION BY mf.book_id ORDER BY ord NULLS LAST, mf.href) AS pos, mf.href FROM mf LEFT JOIN sp USING (book_id, href) WHERE media_type = 'application/xhtml+xml'",
    "spine_warnings": f"WITH {_FILES} SELECT sp.book_id, sp.href, CASE WHEN media_type IS NULL THEN 'missing' ELSE 'not XHTML' END AS warning FROM sp LEFT JOIN mf USING (book_id, href) WHERE media_type IS NULL OR media_type <> 'application/xhtml+xml' UNION ALL SELECT book_id, href, 'not in the spine' FROM mf WHERE media_type = 'application/xhtml+xml' AND href NOT IN (SELECT href FROM sp)",
    "issue_counts": f"WITH {_ISSUES} SELECT severity, id, count(*) AS n FROM iss GROUP BY 1, 2",
    "issue_report": f"WITH {_ISSUES} SELECT doc_id, CASE severity WHEN 'FATAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 END AS rank, path, line FROM iss WHERE severity <> 'INFO'",
    "issue_excerpt": f"WITH {_ISSUES}, l AS (SELECT doc_id, generate_subscripts(l, 1) AS at_line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) SELECT DISTINCT i.doc_id::VARCHAR AS path, i.line, at_line, CASE WHEN at_line = i.line THEN '>>' ELSE '  ' END AS mark, sha256(l.text) AS digest FROM iss i JOIN l ON l.doc_id = i.doc_id AND at_line BETWEEN i.line - 3 AND i.line + 3 WHERE severity = 'ERROR'",
    "severity_gate": f"WITH {_ISSUES} SELECT count(*) FILTER (severity IN ('FATAL', 'ERROR')) AS n_blocking, count(*) FILTER (severity IN ('FATAL', 'ERROR')) = 0 AS passed FROM iss",
    "top_per_group": f"WITH {_ISSUES}, r AS (SELECT path, id, doc_id, row_number() OVER (PARTITION BY path ORDER BY id, doc_id) AS nth, greatest(0, count(*) OVER (PARTITION BY path) - 6) AS more FROM iss) SELECT * FROM r WHERE nth <= 6",
    "exit_code": f"SELECT CASE WHEN bool_or({_LEVEL} IN ('WARNING', 'ERROR')) THEN 2 ELSE 0 END AS exit_code FROM events",
    "alert_fold": f"SELECT event_type AS code, props AS message, count(*) AS occurrences, max(ts) AS created_at, arg_min({_LEVEL}, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS severity FROM events GROUP BY 1, 2",
    "first_incomplete": "WITH r AS (SELECT user_id AS run_id, event_type AS stage, max(value) > 120 AS done FROM events GROUP BY 1, 2) SELECT run_id, min(stage) AS stage FROM r WHERE NOT done GROUP BY 1",
    "json_segments": f"SELECT doc_id AS doc, '$/pages/0/blocks/0' AS path, doc_id AS page_idx, 'text' AS kind, sha256({us('text')}) AS digest, 'confidence' AS source, CASE WHEN doc_id % 130 <= 1 THEN (doc_id % 130)::DOUBLE ELSE (doc_id % 130) / 100 END AS score FROM documents WHERE doc_id % 130 <= 100 AND {us('text')} <> ''",
    "stream_alert_fold": "SELECT event_type, props, count(*) AS occurrences, max(event_id) AS last_event FROM events GROUP BY 1, 2",
    "stream_latest_state": "SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1",
}
