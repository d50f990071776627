"""Queries on books of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import detect as D
from quire.operators import pages as P
from quire.plans.common import BK, BP, CP, docs, pages, plain_sql, quoted, strip_math_sql, table, us
from quire.storage import spread, stored

#: Keyword patterns that are looked for; configuration.
KEYWORDS = ["license", "idiot", r"20\d\d", "[Pp]assword"]


def plan(s, d):
    return P.chunk_plan(P.books(pages(s, d)))


def broken_plan(s, d):
    """The plan with its second chunks shifted by a page, so that there is something to find."""
    second = (F.col("chunk_id") == "c002").cast("int")
    return plan(s, d).withColumn("page_start", F.col("page_start") + second)


def entries(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("page_no"), "text")


def low_pages(s, d):
    bad = table(s, d, "labels").where("quality = 0").select("doc_id")
    return pages(s, d).join(bad, "doc_id", "left_semi").select("book_id", "page_no")


def specs(s, d):
    spec = F.format_string("%d-%d, %d x 0", F.col("doc_id") % 7 + 1, F.col("doc_id") % 11 + 3, F.col("doc_id") % 5 + 20)
    return docs(s, d).select("doc_id", spec.alias("spec"))


def parsed(s, d):
    """Parsed pages by chunk: pages that aren't blank; the third chunks were never parsed."""
    with_chunk = P.with_chunk(pages(s, d), plan(s, d)).join(docs(s, d), "doc_id")
    return with_chunk.where(F.length("text") > 300).where("chunk_id <> 'c003'").groupBy("book_id", "chunk_id").agg(F.count("*").alias("parsed_pages"))


def page_chars_of_books(s, d):
    return P.page_chars_of(pages(s, d, P.text_chars(F.col("text")).alias("chars")))


def overlapping(s, d):
    """A page for each document, that ends with the 192 characters with which the next one of its book begins."""
    run = lambda no: F.concat(*[F.sha2(F.concat_ws(":", "book_id", no.cast("string"), F.lit(i)), 256) for i in range(3)])
    return pages(s, d).select("book_id", "page_no", F.concat(run(F.col("page_no")), F.lit(" x "), run(F.col("page_no") + 1)).alias("text"))


def with_latex(s, d):
    """Pages, of which every third has formulas in and outside of math."""
    more = F.when(F.col("doc_id") % 3 == 0, F.lit(" $a_{1}$ and \\lim or x_{2}")).otherwise(F.lit(" $b^{2}$"))
    return pages(s, d).withColumn("text", F.concat("text", more))


QUERIES = {
    "text_layer": lambda s, d: P.text_layer(pages(s, d, P.text_chars(F.col("text")).alias("chars"))),
    "chunk_plan": plan,
    "chunk_name": lambda s, d: plan(s, d).select("book_id", "chunk_id", P.chunk_name(F.col("book_id")).alias("file")),
    "coverage": lambda s, d: P.coverage_problems(broken_plan(s, d), P.books(pages(s, d))),
    "asof_chunk": lambda s, d: P.with_chunk(pages(s, d), plan(s, d)),
    "page_offset": lambda s, d: P.with_chunk(pages(s, d), plan(s, d)).join(plan(s, d), ["book_id", "chunk_id"]).select("doc_id", (F.col("page_no") - 1 - F.col("page_start")).alias("page_idx"), "page_no"),
    "seams": lambda s, d: P.seams(plan(s, d), page_chars_of_books(s, d)),
    "chunk_reconcile": lambda s, d: P.reconciled(plan(s, d), parsed(s, d)),
    "page_chars": lambda s, d: P.page_chars(entries(s, d)),
    "context_pages": lambda s, d: P.context_pages(low_pages(s, d), P.books(pages(s, d))),
    "uncovered_pages": lambda s, d: P.uncovered_pages(P.books(pages(s, d)), plan(s, d).where("chunk_id <> 'c002'").select("book_id", (F.col("page_start") + 1).alias("page_start"), (F.col("page_end") + 1).alias("page_end"))),
    "page_spec": lambda s, d: specs(s, d).select("doc_id", F.explode(P.page_spec(F.col("spec"))).alias("page")),
    "repeated_paragraphs": lambda s, d: D.repeated_paragraphs(docs(s, d)),
    "repeated_lines": lambda s, d: D.repeated_lines(docs(s, d)),
    "odd_dollar": lambda s, d: D.odd_dollars(docs(s, d)),
    "short_pages": lambda s, d: D.short_of(pages(s, d, D.page_size(F.col("text")).alias("size"))),
    "adjacent_same_head": lambda s, d: D.same_heads_of(stored(pages(s, d, D.page_head(F.col("text")).alias("head")), "heads")),
    "shared_heads": lambda s, d: D.heads(docs(s, d)),
    "page_break_candidates": lambda s, d: D.breaks_of(stored(pages(s, d, *D.page_ends(F.col("text"))), "ends")),
    "adjacent_overlap": lambda s, d: D.adjacent_overlaps(overlapping(s, d)),
    "keyword_hits": lambda s, d: D.keyword_hits(pages(s, d), KEYWORDS),
    "pattern_findings": lambda s, d: D.pattern_counts(table(s, d, "pages").select(F.col("url").alias("book_id"), F.col("page_id").alias("page_no"), F.col("html").alias("text"))),
    "bare_latex": lambda s, d: D.bare_latex(with_latex(s, d)),
    "page_stamps": lambda s, d: docs(s, d).select("doc_id", F.explode(D.page_stamps(F.concat("text", F.lit("表面另"), F.col("doc_id") % 1000, F.lit("一行")))).alias("stamp")),
    "findings": lambda s, d: D.findings_of(spread(table(s, d, "documents").select("source", "doc_id", "text"))),
    "strip_math": lambda s, d: docs(s, d).select("doc_id", F.sha2(X.strip_math(F.col("text")), 256).alias("digest"), F.length(X.strip_math(F.col("text"))).alias("n")),
    "blocks": lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("i", "block")).select("doc_id", "i", F.sha2("block", 256).alias("digest")),
    "excerpt": lambda s, d: docs(s, d).select("doc_id", X.excerpt(F.col("text"), F.substring("text", 301, 40), 200).alias("excerpt")),
    "slug": lambda s, d: docs(s, d).select("doc_id", X.slug(F.col("text")).alias("slug")),
    "title_key": lambda s, d: docs(s, d).select("doc_id", X.title_key(F.col("text")).alias("title_key")),
    "plain_text": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(X.plain(F.col("html")), 256).alias("digest"), F.length(X.plain(F.col("html"))).alias("n")),
    "squash": lambda s, d: docs(s, d).select("doc_id", F.sha2(X.squashed(F.col("text")), 256).alias("digest")),
    "safe_name": lambda s, d: table(s, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name")),
    "occurrences": lambda s, d: docs(s, d).select("doc_id", X.occurrences(F.col("text"), F.lit("the")).alias("n")),
    "escape": lambda s, d: docs(s, d).select("doc_id", F.sha2(X.entities_escaped(F.col("text")), 256).alias("digest")),
}

_BREAK = f"NOT regexp_matches(t, {quoted(D.NO_BREAK_TAIL)}) AND NOT regexp_matches(nt, {quoted(D.BLOCK_START)}) AND NOT regexp_matches(nt, {quoted(D.NO_BREAK_HEAD)})"
_TEXT_LAYER = f"SELECT book_id, count(*) AS sampled_pages, round(sum(length({us('text')})) / count(*), 6) AS chars_per_page, sum(length({us('text')})) >= 40 * count(*) AS has_text_layer FROM (SELECT *, page_no - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM bp) WHERE n <= 12 OR (i % greatest(1, n // 12) = 0 AND i < 12 * greatest(1, n // 12)) OR i = n // 2 OR i = n - 1 GROUP BY 1"
_ASOF = "asof_ AS (SELECT b.book_id, page_no, doc_id, chunk_id, page_start FROM bp b ASOF JOIN cp c ON b.book_id = c.book_id AND b.page_no >= c.page_start + 1)"
_FIND = "SELECT {0} AS detector, book_id, page_no, {1} AS n, {2} AS evidence"
_SHORT = f"sz AS (SELECT book_id, page_no, length({us('text')}) AS size FROM bp), md AS (SELECT book_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM sz GROUP BY 1)"
_SHORT_Q = "SELECT CASE WHEN size = 0 THEN 'empty_page' ELSE 'short_page' END AS detector, book_id, page_no, size AS n, median::VARCHAR AS evidence FROM sz JOIN md USING (book_id) WHERE size < greatest(60, 0.15 * median)"
_HEADS = f"hd AS (SELECT book_id, page_no, left({us('text')}, 80) AS t, lead(left({us('text')}, 80)) OVER (PARTITION BY book_id ORDER BY page_no) AS nt FROM bp)"
_HEADS_Q = "SELECT 'same_head' AS detector, book_id, page_no, 1::BIGINT AS n, t AS evidence FROM hd WHERE length(t) = 80 AND t = nt"
_BREAKS = f"br AS (SELECT book_id, page_no, {us('text')} AS t, lead({us('text')}) OVER w AS nt, lead(page_no) OVER w AS np FROM bp WINDOW w AS (PARTITION BY book_id ORDER BY page_no))"
_BREAKS_Q = f"SELECT 'page_break' AS detector, book_id, page_no, np AS n, right(t, 18) || ' | ' || left(nt, 18) AS evidence FROM br WHERE np = page_no + 1 AND t <> '' AND nt <> '' AND {_BREAK}"
_DOLLAR = f"dl AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), od AS (SELECT doc_id, line_no, len(regexp_extract_all({us('line')}, '\\$')) AS dollars FROM dl WHERE NOT starts_with({us('line')}, '<!--'))"
_PATTERN = lambda rel: " UNION ALL ".join(f"SELECT {quoted(k)} AS detector, book_id, page_no, len(regexp_extract_all(text, {quoted(p)})) AS n, regexp_extract(text, {quoted(p)}) AS evidence FROM {rel} WHERE regexp_matches(text, {quoted(p)})" for k, p in D.PATTERNS.items())

_RUN = lambda no: " || ".join(f"sha256(book_id || ':' || {no} || ':{i}')" for i in range(3))

SQL = {
    "adjacent_overlap": f"WITH {BP} SELECT 'adjacent_overlap' AS detector, book_id, page_no, 192 AS n, left({_RUN('(page_no + 1)')}, 60) AS evidence FROM bp QUALIFY lead(page_no) OVER (PARTITION BY book_id ORDER BY page_no) IS NOT NULL",
    "bare_latex": f"WITH {BP}, t AS (SELECT book_id, page_no, regexp_extract_all({strip_math_sql("(text || CASE WHEN doc_id % 3 = 0 THEN ' $a_{1}$ and \\lim or x_{2}' ELSE ' $b^{2}$' END)")}, '\\\\[a-zA-Z]{{2,}}|[0-9A-Za-z)\\]][_^]\\{{') AS h FROM bp) SELECT 'bare_latex' AS detector, book_id, page_no, len(h) AS n, h[1] AS evidence FROM t WHERE len(h) > 0",
    "page_stamps": "SELECT doc_id, doc_id % 1000 AS stamp FROM documents WHERE text IS NOT NULL",
    "text_layer": f"WITH {BP} {_TEXT_LAYER}",
    "chunk_plan": f"WITH {CP} SELECT * FROM cp",
    "chunk_name": f"WITH {CP} SELECT book_id, chunk_id, format('{{}}.{{}}.p{{:04d}}-{{:04d}}.pdf', book_id, chunk_id, page_start + 1, page_end + 1) AS file FROM cp",
    "coverage": f"WITH {CP}, r AS (SELECT book_id, chunk_id, page_start + (chunk_id = 'c002')::INT AS page_start, page_end FROM cp), w AS (SELECT r.*, page_count, coalesce(lag(page_end) OVER o + 1, 0) AS want, lead(page_start) OVER o IS NULL AS last FROM r JOIN bk USING (book_id) WINDOW o AS (PARTITION BY book_id ORDER BY page_start, chunk_id)) SELECT book_id, chunk_id, CASE WHEN page_start > want THEN 'gap' ELSE 'overlap' END AS problem, page_start AS at, want AS expected FROM w WHERE page_start <> want UNION ALL SELECT book_id, chunk_id, 'tail', page_end, page_count - 1 FROM w WHERE last AND page_end < page_count - 1",
    "asof_chunk": f"WITH {CP}, {_ASOF} SELECT book_id, page_no, doc_id, chunk_id FROM asof_",
    "page_offset": f"WITH {CP}, {_ASOF} SELECT doc_id, page_no - 1 - page_start AS page_idx, page_no FROM asof_",
    "seams": f"WITH {CP}, ch AS (SELECT book_id, page_no, length({us('text')}) AS chars FROM bp), s AS (SELECT book_id, chunk_id AS left_chunk, lead(chunk_id) OVER o AS right_chunk, page_end + 1 AS left_page, lead(page_start) OVER o + 1 AS right_page FROM cp WINDOW o AS (PARTITION BY book_id ORDER BY page_start)) SELECT s.*, l.chars AS left_chars, r.chars AS right_chars, CASE WHEN l.chars IS NULL OR r.chars IS NULL THEN 'unknown' WHEN l.chars = 0 OR r.chars = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM s LEFT JOIN ch l ON l.book_id = s.book_id AND l.page_no = left_page LEFT JOIN ch r ON r.book_id = s.book_id AND r.page_no = right_page WHERE right_chunk IS NOT NULL",
    "chunk_reconcile": f"WITH {CP}, {_ASOF}, p AS (SELECT a.book_id, chunk_id, count(*) AS parsed_pages FROM asof_ a JOIN documents d USING (doc_id) WHERE length(d.text) > 300 AND chunk_id <> 'c003' GROUP BY 1, 2) SELECT book_id, chunk_id, page_end - page_start + 1 AS expected_pages, parsed_pages, CASE WHEN parsed_pages IS NULL THEN 'missing' WHEN parsed_pages < page_end - page_start + 1 THEN 'short' WHEN parsed_pages > page_end - page_start + 1 THEN 'extra' ELSE 'ok' END AS status FROM cp LEFT JOIN p USING (book_id, chunk_id)",
    "page_chars": f"SELECT conv_id AS book_id, turn + 1 AS page_no, sum(coalesce(length({us('text')}), 0))::BIGINT AS chars FROM conversations GROUP BY 1, 2",
    "context_pages": f"WITH {BK}, low AS (SELECT book_id, page_no FROM bp JOIN labels USING (doc_id) WHERE quality = 0) SELECT DISTINCT book_id, p AS page_no FROM (SELECT book_id, unnest(range(page_no - 1, page_no + 2)) AS p FROM low) JOIN bk USING (book_id) WHERE p BETWEEN 1 AND page_count",
    "uncovered_pages": f"WITH {CP} SELECT book_id, p AS page_no FROM (SELECT book_id, unnest(range(1, page_count + 1)) AS p FROM bk) EXCEPT SELECT book_id, unnest(range(page_start + 1, page_end + 2)) FROM cp WHERE chunk_id <> 'c002'",
    "page_spec": "SELECT DISTINCT doc_id, unnest(list_concat(range(doc_id % 7 + 1, doc_id % 11 + 4), [doc_id % 5 + 20])) AS page FROM documents",
    "repeated_paragraphs": f"WITH p AS (SELECT doc_id, {us('q')} AS paragraph FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS q FROM documents)) SELECT paragraph, count(*) AS n, min(doc_id) AS first_page, max(doc_id) AS last_page FROM p WHERE length(paragraph) >= 40 AND NOT regexp_matches(paragraph, '^(<div|<!--|\\|)') GROUP BY 1 HAVING count(*) >= 2",
    "repeated_lines": f"WITH p AS (SELECT doc_id, {us('q')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS q FROM documents)) SELECT line, count(*) AS n, min(doc_id) AS first_page, max(doc_id) AS last_page FROM p WHERE length(line) >= 40 GROUP BY 1 HAVING count(*) >= 2",
    "odd_dollar": f"WITH {_DOLLAR} SELECT doc_id, line_no, dollars FROM od WHERE dollars % 2 = 1",
    "short_pages": f"WITH {BP}, {_SHORT} {_SHORT_Q}",
    "adjacent_same_head": f"WITH {BP}, {_HEADS} {_HEADS_Q}",
    "shared_heads": f"SELECT left({us('text')}, 80) AS head, count(*) AS n, min(doc_id) AS first_page FROM documents WHERE length({us('text')}) >= 80 GROUP BY 1 HAVING count(*) >= 2",
    "page_break_candidates": f"WITH {BP}, {_BREAKS} {_BREAKS_Q}",
    "keyword_hits": f"WITH {BP}, k(keyword) AS (VALUES {', '.join(f'({quoted(k)})' for k in KEYWORDS)}) SELECT book_id, page_no, keyword, len(regexp_extract_all(text, keyword)) AS n FROM bp, k WHERE regexp_matches(text, keyword)",
    "pattern_findings": f"WITH pg AS (SELECT url AS book_id, page_id AS page_no, html AS text FROM pages) {_PATTERN('pg')}",
    "findings": f"WITH {BP}, {_SHORT}, {_HEADS}, {_BREAKS}, {_DOLLAR}, bl AS (SELECT book_id, page_no, regexp_extract_all({strip_math_sql('text')}, '\\\\[a-zA-Z]{{2,}}|[0-9A-Za-z)\\]][_^]\\{{') AS h FROM bp) {_SHORT_Q} UNION ALL {_HEADS_Q} UNION ALL {_BREAKS_Q} UNION ALL {_PATTERN('bp')} UNION ALL SELECT 'bare_latex', book_id, page_no, len(h), h[1] FROM bl WHERE len(h) > 0 UNION ALL SELECT 'odd_dollar', book_id, page_no, count(*), '' FROM od JOIN bp USING (doc_id) WHERE dollars % 2 = 1 GROUP BY doc_id, book_id, page_no",
    "strip_math": f"SELECT doc_id, sha256({strip_math_sql('text')}) AS digest, length({strip_math_sql('text')}) AS n FROM documents",
    "blocks": f"SELECT doc_id, i - 1 AS i, sha256(b[i]) AS digest FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {us('x')}), lambda x: x <> '') AS b FROM documents))",
    "excerpt": f"WITH k AS (SELECT doc_id, text, left(string_split({us('substring(text, 301, 40)')}, chr(10))[1], 60) AS key FROM documents), a AS (SELECT *, CASE WHEN key = '' THEN 0 ELSE strpos(text, key) END AS pos FROM k), c AS (SELECT *, greatest(0, pos - 101) AS s, least(length(text), pos + 99) AS e FROM a) SELECT doc_id, CASE WHEN pos = 0 THEN '' ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substring(text, s + 1, e - s) || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS excerpt FROM c",
    "slug": "SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '-{2,}', '-', 'g'), 60) AS slug FROM documents",
    "title_key": "SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS title_key FROM documents",
    "plain_text": f"SELECT page_id, sha256({plain_sql('html')}) AS digest, length({plain_sql('html')}) AS n FROM pages",
    "squash": "SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\s\\x{a0}]+', '', 'g'))) AS digest FROM documents",
    "safe_name": "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^\\p{L}\\p{N}_.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM pages",
    "occurrences": "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents",
    "escape": "SELECT doc_id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents",
}
