"""Queries on result files, layout boxes, outlines, packages and edits of whole tables; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.markup import SAMPLE_MARKER
from quire.operators import compose as C
from quire.operators import diff as T
from quire.operators import formulas as B
from quire.operators import geometry as G
from quire.operators import lint as I
from quire.operators import orders as O
from quire.operators import package as K
from quire.operators import pages as P
from quire.operators import segments as J
from quire.operators import state as S
from quire.operators import tables as H
from quire.operators import translate as R
from quire.plans.box_queries import boxes, streamed
from quire.plans.common import BP, CP, docs, pages, quoted, spread_docs, squashed_sql, table, us
from quire.plans.record_queries import _LAST, seam_pages
from quire.streaming import folds


def corners(box):
    return F.array(*[F.col(f"{box}.{k}") for k in ("x0", "y0", "x1", "y1")])


def content_files(s, d):
    """A content list for each label: its even vectors' boxes on the scale 0 to 1000, four pages."""
    item = F.struct("vec_id", F.struct(F.concat(F.lit("v"), "vec_id").alias("text"), F.lit("text").alias("type"), (F.col("vec_id") % 4).alias("page_idx"), F.transform(corners("box"), lambda x: x * 1000).alias("bbox")).alias("item"))
    lists = boxes(s, d).where("vec_id % 2 = 0").groupBy(F.col("page").alias("bundle")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("bundle", F.to_json(F.transform("items", lambda x: x["item"])).alias("value"))


def model_files(s, d):
    """A layout result for each label: a list of its odd vectors' boxes with scores, each naming its page."""
    node = F.struct("vec_id", F.struct(F.lit("line").alias("type"), F.lit("t").alias("text"), "score", (F.col("vec_id") % 4).alias("page_idx"), corners("box").alias("bbox")).alias("node"))
    lists = boxes(s, d).where("vec_id % 2 = 1").groupBy(F.col("page").alias("doc")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return lists.select("doc", F.to_json(F.transform("nodes", lambda x: x["node"])).alias("value"))


def layout_segments(s, d):
    """From files to segments: items and layout nodes are read from JSON, brought to one scale, and joined by overlap."""
    segments = J.content_segments(content_files(s, d))
    nodes = J.scored_nodes(model_files(s, d)).withColumnRenamed("doc", "bundle")
    none = F.lit(None).cast("double")
    systems = G.coordinate_systems(segments.select("bundle", "box", none.alias("width"), none.alias("height"))).withColumn("width", none).withColumn("height", none)
    layout = J.layout_index(J.scored_layout(nodes), J.scored_layout(nodes.where("false")))
    return J.layout_scored(segments, layout, systems).select("bundle", "segment_id", "page_idx", "text", "score", "source", "lines")


def result_lines(s, d):
    """A result line for each vector: one or two pages, of one to three blocks."""
    v = lambda i: F.abs(F.col("embedding")[i].cast("double")) * 1000
    block = lambda k, at: F.struct(F.lit(k).alias("block_label"), F.array(*[v(at + i) for i in range(4)]).alias("block_bbox"))
    page = lambda *b: F.struct(F.struct(F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"), F.array(*b).alias("parsing_res_list")).alias("prunedResult"))
    pages = F.when(F.col("vec_id") % 3 == 0, F.array(page(block("text", 0)), page(block("image", 4), block("table", 8), block("text", 12)))).otherwise(F.array(page(block("text", 0), block("image", 4))))
    return table(s, d, "embeddings").select(F.col("label").alias("bundle"), F.col("vec_id").alias("line_no"), F.to_json(F.struct(F.struct(pages.alias("layoutParsingResults")).alias("result"))).alias("value"))


def result_boxes(s, d):
    return J.parsed_boxes(result_lines(s, d)).select("bundle", "page", "label", "ord", "width", F.col("box.x0").alias("x0"), F.col("box.y1").alias("y1"))


def tokens_before(s, d):
    """Each document's tokens, asked for on the next document's page."""
    return docs(s, d).select((F.col("doc_id") + 1).alias("page_no"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))


def rows_missing(s, d):
    """A row for each line: its first word as the key, its second one to be found too; the text layer has every other line."""
    lines = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    word = lambda n: F.regexp_extract("line", r"^(\S+)\s+(\S+)", n)
    asked = lines.select(F.col("doc_id").alias("page_no"), F.col("i").alias("row_no"), word(1).alias("key"), F.array(word(2)).alias("words")).where("key <> ''")
    return H.rows_missing(asked, lines.where("i % 2 = 0").select(F.col("doc_id").alias("page_no"), "line")).select("page_no", "row_no", "found")


def outline_entries(s, d):
    title = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.split("text", "\n")[0])
    return table(s, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 3 + 1).alias("level"), title.alias("title"), F.when(F.col("doc_id") % 5 != 0, F.length("text")).alias("page"))


def binomial_formulas(s, d):
    """Every three words of a document as a binomial with a nested group; each second one has an exponent."""
    text = F.regexp_replace("text", r"[\\{}^_]", " ")
    text = F.regexp_replace(text, r"([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)", r"\\binom{$1}{\\mathbf{$2}}^$3")
    return spread_docs(s, d).select(F.col("doc_id").alias("id"), F.regexp_replace(text, r"\^([A-Za-z]*[aeiou]) ", " $1 ").alias("latex"))


def stage_files(s, d):
    """Files of packages: those of a supplier, every seventh one generated."""
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_shipdate").cast("timestamp").alias("mtime"), (F.col("l_partkey") % 7 == 0).alias("generated"))


def checker_reports(s, d):
    return table(s, d, "documents").select((F.col("doc_id") % 2 == 0).alias("ran"), F.length("text").alias("files"), F.when(F.col("doc_id") % 11 == 0, F.col("source")).otherwise("").alias("error"), F.col("doc_id").alias("ord"))


def issue_rows(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("id"), F.element_at(F.array(F.lit("ERROR"), F.lit("WARNING"), F.lit("INFO")), (F.col("event_id") % 3 + 1).cast("int")).alias("severity"), F.col("props").alias("path"), (F.col("event_id") % 50).cast("int").alias("line"), F.col("event_id").cast("string").alias("message"))


def issue_order(s, d):
    """Each issue's place in the report's order, within its severity."""
    order = Window.partitionBy("severity").orderBy("id", "path", "line", "message")
    return I.ordered(issue_rows(s, d)).withColumn("nth", F.row_number().over(order)).select("message", "nth")


def stage_rows(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("run_id"), F.posexplode(F.array(*[F.lit(x) for x in S.STAGES])).alias("ord", "stage"), F.length("text").alias("n"))
    return rows.withColumn("status", F.when(F.col("n") % 4 == F.col("ord"), "FAILED").when(F.col("n") % 5 == F.col("ord"), "SKIPPED").otherwise("DONE"))


def invalidated_stages(s, d):
    """What is gone through again after the second stage's input changed in every third run, and the third is forced."""
    changed = docs(s, d).where("doc_id % 3 = 0").select(F.col("doc_id").alias("run_id"), F.lit(1).alias("ord"))
    return S.to_run(S.invalidated(stage_rows(s, d).drop("n"), changed), force=2)


def context_alerts(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 20).cast("string").alias("message"), F.lit("WARNING").alias("severity"), "ts", F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise("").alias("context"))
    return S.folded_alerts(rows).select("code", "message", "occurrences", "context")


def sizes(s, d):
    v = lambda i: F.round(F.col("embedding")[i].cast("double") * 100)
    return table(s, d, "embeddings").select(F.col("label").alias("bundle"), F.col("vec_id").alias("page"), v(0).alias("width"), v(1).alias("height"))


def order_parts(s, d):
    """A segment for each page: 60 characters from its text's 101st on, with a score by its length."""
    p = pages(s, d)
    segments = p.select("book_id", F.format_string("S%05d", "page_no").alias("segment_id"), "page_no", (F.length("text") % 100 / 100).alias("score"), F.substring("text", 101, 60).alias("text"))
    return segments, p


def work_orders(s, d):
    segments, p = order_parts(s, d)
    return O.order_segments(segments, p, 0.3, 20).select("book_id", "nth", "segment_id", "page_no", "score", F.sha2("excerpt", 256).alias("digest"))


def order_counts(s, d):
    segments, p = order_parts(s, d)
    seams = seam_pages(s, d)
    return O.work_order(segments, p, seams, P.books(p), 0.3, 20)[2].select("book_id", "segments", "low", "seams")


def chapter_files(s, d):
    """A source's documents as its chapters; of a third of the languages they are samples or empty."""
    text = F.when(F.col("n_chars") % 3 == 0, F.lit(SAMPLE_MARKER)).when(F.col("n_chars") % 3 == 1, F.lit(" ")).otherwise(F.col("text"))
    return table(s, d, "documents").select(F.concat_ws("-", "source", F.col("n_chars") % 3).alias("book_id"), F.col("doc_id").alias("name"), text.alias("text"))


QUERIES = {
    "work_orders": work_orders,
    "order_counts": order_counts,
    "composed": lambda s, d: O.composed(chapter_files(s, d)),
    "layout_segments": layout_segments,
    "result_boxes": result_boxes,
    "written_differently": lambda s, d: T.written_differently(tokens_before(s, d), docs(s, d).select(F.col("doc_id").alias("page_no"), "text")),
    "rows_missing": rows_missing,
    "outline_flat": lambda s, d: C.flattened_outline(outline_entries(s, d)),
    "outline_kept": lambda s, d: C.flattened_outline(outline_entries(s, d), keep_broken=True),
    "outline_top": lambda s, d: C.flattened_outline(outline_entries(s, d), top_only=True),
    "grouped_binomials": lambda s, d: B.grouped_binomials(binomial_formulas(s, d)).select("id", F.sha2("latex", 256).alias("digest")),
    "modified_stamp": lambda s, d: K.modified_stamp(stage_files(s, d)),
    "merged_reports": lambda s, d: I.merged(checker_reports(s, d)),
    "issue_order": issue_order,
    "latest_run": lambda s, d: S.latest_run(table(s, d, "events").select(F.col("event_id").alias("run_id"), F.struct("value", "event_id").alias("created_at"))),
    "invalidated_stages": invalidated_stages,
    "context_alerts": context_alerts,
    "representative_size": lambda s, d: G.representative_size(sizes(s, d)),
    "titles_translated": lambda s, d: R.titles_translated(docs(s, d).select("doc_id", F.split("text", "\n")[0].alias("title")), docs(s, d).where("doc_id % 3 = 0").select(F.split("text", "\n")[0].alias("t")).distinct().select(R.cache_key(F.col("t")).alias("key"), F.concat(F.lit("zh: "), "t").alias("translated"))).select("doc_id", F.sha2("shown", 256).alias("digest")),
    "last_occurrence": lambda s, d: K.last_occurrences(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id"),
    "stream_stuck_jobs": lambda s, d: streamed(s, d, folds.stuck_jobs, "append").select("user_id", "n_events", "last_type", F.col("last_ts").cast("timestamp_ntz").alias("last_ts")),
    "stream_windows": lambda s, d: streamed(s, d, folds.windowed_counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
}

_B = "b AS (SELECT vec_id, label AS bundle, least(abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE)) AS x0, least(abs(embedding[3]::DOUBLE), abs(embedding[4]::DOUBLE)) AS y0, greatest(abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE)) AS x1, greatest(abs(embedding[3]::DOUBLE), abs(embedding[4]::DOUBLE)) AS y1, abs(embedding[5]::DOUBLE) AS score FROM embeddings)"
_SEG = "s AS (SELECT bundle, format('S{:05d}', row_number() OVER (PARTITION BY bundle ORDER BY vec_id)) AS segment_id, (vec_id % 4)::INT AS page_idx, 'v' || vec_id AS text, x0 * 1000 / 1000 AS x0, y0 * 1000 / 1000 AS y0, x1 * 1000 / 1000 AS x1, y1 * 1000 / 1000 AS y1 FROM b WHERE vec_id % 2 = 0)"
_C = "(greatest(0, least(s.x1, l.x1) - greatest(s.x0, l.x0)) * greatest(0, least(s.y1, l.y1) - greatest(s.y0, l.y0)))"
_AREA = lambda r: f"(greatest(0, {r}.x1 - {r}.x0) * greatest(0, {r}.y1 - {r}.y0))"
_V = lambda i: f"abs(embedding[{i + 1}]::DOUBLE) * 1000"
_OUT = "o AS (SELECT source AS book_id, doc_id AS seq, doc_id % 3 + 1 AS level, CASE WHEN doc_id % 7 = 0 THEN '' ELSE trim(string_split(text, chr(10))[1]) END AS title, CASE WHEN doc_id % 5 <> 0 THEN length(text) END AS page FROM documents)"
_TOK = f"SELECT DISTINCT doc_id + 1 AS page_no, regexp_replace(t, '^[._\\-$#]+|[._\\-$#]+$', '', 'g') AS token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, {quoted(T.TAG)}, ' ', 'g')), {quoted(T.TOKEN)})) AS t FROM documents)"
_STAGE = "st AS (SELECT doc_id AS run_id, ord, stage, CASE WHEN length(text) % 4 = ord THEN 'FAILED' WHEN length(text) % 5 = ord THEN 'SKIPPED' ELSE 'DONE' END AS status FROM documents, (VALUES (0, 'prepare'), (1, 'calibrate'), (2, 'compose'), (3, 'check')) t(ord, stage))"
_GROUP = r"\{(?:[^{}]|\{[^{}]*\})*\}"

_LOWEST = f"w AS (SELECT book_id, format('S{{:05d}}', page_no) AS segment_id, page_no, length(text) % 100 / 100.0::DOUBLE AS score, left(string_split({us('substring(text, 101, 60)')}, chr(10))[1], 60) AS key, text FROM bp), lowest AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score, page_no, segment_id) AS nth FROM w WHERE score < 0.3 QUALIFY nth <= 20)"

SQL = {
    "work_orders": f"WITH {BP}, {_LOWEST}, a AS (SELECT *, CASE WHEN key = '' THEN 0 ELSE strpos(text, key) END AS pos FROM lowest), c AS (SELECT *, greatest(0, pos - 201) AS s, least(length(text), pos + 199) AS e FROM a) SELECT book_id, nth, segment_id, page_no, score, sha256(CASE WHEN pos = 0 THEN '' ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, s + 1, e - s) || CASE WHEN e < length(text) THEN '…' ELSE '' END END) AS digest FROM c",
    "order_counts": f"WITH {CP}, {_LAST}, {_LOWEST}, n AS (SELECT book_id, count(*) AS segments FROM bp GROUP BY 1), l AS (SELECT book_id, count(*) AS low FROM lowest GROUP BY 1), z AS (SELECT book_id, count(*) AS seams FROM seam GROUP BY 1) SELECT n.book_id, segments, coalesce(low, 0) AS low, coalesce(seams, 0) AS seams FROM n LEFT JOIN l ON l.book_id = n.book_id LEFT JOIN z ON z.book_id = n.book_id",
    "composed": "WITH c AS (SELECT concat_ws('-', source, n_chars % 3) AS book_id, n_chars % 3 = 2 AND trim(text) <> '' AS done FROM documents) SELECT book_id, count(*) AS chapters, count(*) FILTER (done) AS written, count(*) FILTER (done) > 0 AS ready FROM c GROUP BY 1",
    "layout_segments": f"WITH {_B}, {_SEG}, l AS (SELECT bundle, vec_id % 4 AS page, x0, y0, x1, y1, score FROM b WHERE vec_id % 2 = 1), h AS (SELECT s.bundle, segment_id, min(score) AS score, count(*) AS lines FROM s JOIN l ON s.bundle = l.bundle AND s.page_idx = l.page WHERE {_C} > 0 AND ({_C} >= 0.5::DOUBLE * {_AREA('s')} AND {_AREA('s')} > 0 OR {_C} >= 0.5::DOUBLE * greatest({_AREA('l')}, 1e-9::DOUBLE)) GROUP BY 1, 2) SELECT s.bundle, s.segment_id, page_idx, text, score, CASE WHEN score IS NULL THEN 'none' ELSE 'layout:score' END AS source, coalesce(lines, 0) AS lines FROM s LEFT JOIN h USING (bundle, segment_id)",
    "result_boxes": f"WITH p AS (SELECT label AS bundle, vec_id, unnest(CASE WHEN vec_id % 3 = 0 THEN [1, 2] ELSE [3] END) AS kind, embedding FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY vec_id, kind) - 1 AS page FROM p), k AS (SELECT *, unnest(CASE kind WHEN 1 THEN [{{'o': 0, 'l': 'text', 'a': 0}}] WHEN 2 THEN [{{'o': 0, 'l': 'image', 'a': 4}}, {{'o': 1, 'l': 'table', 'a': 8}}, {{'o': 2, 'l': 'text', 'a': 12}}] ELSE [{{'o': 0, 'l': 'text', 'a': 0}}, {{'o': 1, 'l': 'image', 'a': 4}}] END) AS b FROM n) SELECT bundle, page, b.l AS label, b.o AS ord, 1000.0::DOUBLE AS width, abs(embedding[b.a + 1]::DOUBLE) * 1000 AS x0, abs(embedding[b.a + 4]::DOUBLE) * 1000 AS y1 FROM k",
    "written_differently": f"WITH t AS ({_TOK}), f AS (SELECT doc_id AS page_no, {squashed_sql('text')} AS flat FROM documents) SELECT page_no, token FROM t JOIN f USING (page_no) WHERE length(token) >= 3 AND contains(flat, token)",
    "rows_missing": r"WITH l AS (SELECT doc_id AS page_no, unnest(range(len(string_split(text, chr(10))))) AS row_no, unnest(string_split(text, chr(10))) AS line FROM documents), q AS (SELECT page_no, row_no, lower(regexp_extract(line, '^(\S+)\s+(\S+)', 1)) AS k, lower(regexp_extract(line, '^(\S+)\s+(\S+)', 2)) AS w FROM l), f AS (SELECT page_no, lower(regexp_replace(line, '\s+', '', 'g')) AS flat FROM l WHERE row_no % 2 = 0) SELECT page_no, row_no, EXISTS (SELECT 1 FROM f WHERE f.page_no = q.page_no AND starts_with(flat, k) AND contains(flat, w)) AS found FROM q WHERE k <> ''",
    "outline_flat": f"WITH {_OUT} SELECT * FROM o WHERE title <> '' AND page IS NOT NULL",
    "outline_kept": f"WITH {_OUT} SELECT * REPLACE (coalesce(page, -1) AS page) FROM o",
    "outline_top": f"WITH {_OUT} SELECT * REPLACE (coalesce(page, 0) AS page) FROM o WHERE level = 1",
    "grouped_binomials": rf"WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '[\\{{}}^_]', ' ', 'g'), '([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)', '\\binom{{\1}}{{\\mathbf{{\2}}}}^\3', 'g'), '\^([A-Za-z]*[aeiou]) ', ' \1 ', 'g') AS latex FROM documents) SELECT id, sha256(regexp_replace(latex, '(\\binom\s*{_GROUP}\s*{_GROUP})(\s*[\^_])', '{{\1}}\2', 'g')) AS digest FROM t",
    "modified_stamp": "SELECT l_suppkey AS book_id, strftime(max(l_shipdate) FILTER (l_partkey % 7 <> 0), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM lineitem GROUP BY 1",
    "merged_reports": "SELECT bool_or(doc_id % 2 = 0) AS ran, sum(length(text)) AS files, coalesce(string_agg(source, ' | ' ORDER BY doc_id) FILTER (doc_id % 11 = 0), '') AS error FROM documents",
    "issue_order": "SELECT event_id::VARCHAR AS message, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_type, props, event_id % 50, event_id::VARCHAR) AS nth FROM events",
    "latest_run": "SELECT event_id AS run_id FROM events ORDER BY value DESC, event_id DESC LIMIT 1",
    "invalidated_stages": f"WITH {_STAGE}, i AS (SELECT * REPLACE (CASE WHEN run_id % 3 = 0 AND ord > 1 THEN 'PENDING' ELSE status END AS status) FROM st), f AS (SELECT run_id, min(ord) AS first FROM i WHERE ord = 2 OR status NOT IN ('DONE', 'SKIPPED') GROUP BY 1) SELECT run_id, stage, ord FROM i JOIN f USING (run_id) WHERE ord >= first",
    "context_alerts": "SELECT event_type AS code, (user_id % 20)::VARCHAR AS message, count(*) AS occurrences, (arg_max(props, {'t': ts, 'i': event_id}) FILTER (event_id % 3 <> 0 AND length(props) > 0)) AS context FROM events GROUP BY 1, 2",
    "representative_size": "WITH s AS (SELECT label AS bundle, vec_id, round(embedding[1]::DOUBLE * 100) AS width, round(embedding[2]::DOUBLE * 100) AS height FROM embeddings) SELECT bundle, arg_min(width, vec_id) AS width, arg_min(height, vec_id) AS height FROM s WHERE width > 0 AND height > 0 GROUP BY 1",
    "titles_translated": "WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents) SELECT doc_id, sha256(CASE WHEN title IN (SELECT title FROM t WHERE doc_id % 3 = 0) THEN 'zh: ' || title ELSE title END) AS digest FROM t",
    "last_occurrence": "SELECT user_id, event_id, value FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)",
    "stream_stuck_jobs": "WITH j AS (SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1) SELECT * FROM j WHERE last_ts + INTERVAL 6 HOURS < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
