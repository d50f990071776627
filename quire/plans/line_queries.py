"""Queries on lines, headings, contents and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import compose as C
from quire.operators import diff as T
from quire.operators import edits as E
from quire.operators import interval_edits as V
from quire.operators import lines as L
from quire.operators import pages as P
from quire.operators import package as K
from quire.operators import state as S
from quire.operators import translate as R
from quire.functions.text import needs_translation, squashed
from quire.plans.common import BK, BP, any_sql, docs, pages, quoted, spread_docs, squashed_sql, table, us


def kinds(s, d):
    return L.kinds(spread_docs(s, d))


def cache(s, d):
    """A translation cache that has the lines of every third document."""
    ls = L.translatable(kinds(s, d)).where("doc_id % 3 = 0").select("line").distinct()
    return ls.select(R.cache_key(F.col("line")).alias("key"), F.concat(F.lit("zh: "), "line").alias("translated"))


def titles(s, d):
    """Pages whose first line begins with a capital of the alphabet's first half: where chapters begin."""
    head = F.split("text", "\n")[0]
    return pages(s, d).where(head.rlike("^[A-M]")).select("book_id", F.col("page_no").alias("start_page"), head.alias("title"))


def outline(s, d):
    return pages(s, d).select("book_id", F.col("page_no").alias("seq"), (F.col("doc_id") * 7919 % 101).cast("int").alias("page"))


def contents(s, d):
    key = F.left(squashed(F.col("text")), F.lit(20))
    return pages(s, d).select("book_id", F.col("page_no").alias("seq"), (F.col("page_no") + F.col("doc_id") % 3 - 1).cast("int").alias("page"), key.alias("key"))


def nested(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("toc"), F.col("turn").alias("seq"), (1 + F.length("text") % 3).alias("level"))


def headings(s, d):
    """The beginning of each page as a heading of its book; cut where a document is read, so no text is shuffled."""
    begin = F.left("text", F.lit(40)).alias("title")
    return P.book_pages(table(s, d, "documents"), begin).select("book_id", F.col("page_no").alias("line_no"), "title", "doc_id")


def layer(s, d):
    return table(s, d, "benchmark").select("item_id", "text")


def diff_pairs(s, d):
    """A page against the next one of its book, both whole."""
    from quire.operators.detect import neighbours

    return neighbours(pages(s, d), "text").where("next_text is not null").select(F.col("doc_id").alias("page_no"), F.col("text").alias("left"), F.col("next_text").alias("right"))


def edit_plan(s, d):
    """An edit for each document, of an op by its number, with places taken from its text; every third gets one that is refused as well."""
    op = lambda *by: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in by]), (F.col("doc_id") % 5 + 1).cast("int"))
    part = lambda p: F.regexp_extract("text", p, 1)
    none = F.lit(None).cast("int")
    first = docs(s, d).select(F.col("doc_id").alias("book_id"), F.lit(0).alias("seq"), op("append", "join", "replace", "regex", "drop_paragraph").alias("op"), op(part("([A-Za-z]+ [A-Za-z]+)"), part("([A-Za-z]+)\\s+[A-Za-z]"), part("([A-Za-z]+ [A-Za-z]+)"), "[0-9]+", part("([A-Za-z]+)")).alias("find"), op("[added]", "", "[new]", "#", "").alias("with_"), none.alias("expect"), none.alias("occurrence"), part("[A-Za-z]+\\s+([A-Za-z]+)").alias("right_head"))
    never = first.where("book_id % 3 = 0").select("book_id", F.lit(1).alias("seq"), F.lit("replace").alias("op"), F.lit("@@none@@").alias("find"), F.lit("").alias("with_"), "expect", "occurrence", F.lit("").alias("right_head"))
    return first.unionByName(never)


def edited_lines(s, d):
    """Documents as books whose pages are their lines."""
    return V.edited(L.numbered_lines(spread_docs(s, d)).select(F.col("doc_id").alias("book_id"), F.col("line_no").alias("page_no"), F.col("line").alias("text")), edit_plan(s, d))


def edited_texts(s, d):
    outcomes, made = edited_lines(s, d)
    return V.whole_texts(made).join(outcomes.where("seq = 0"), "book_id").select("book_id", "status", F.sha2("text", 256).alias("digest"))


QUERIES = {
    "edited_texts": edited_texts,
    "line_kind": lambda s, d: kinds(s, d).select("doc_id", "line_no", "kind"),
    "prose_score": lambda s, d: L.numbered_lines(docs(s, d)).select("doc_id", "line_no", L.prose_score(F.col("line")).alias("score")),
    "block_is_code": lambda s, d: docs(s, d).select("doc_id", L.block_is_code(F.col("text")).alias("is_code")),
    "heading_level": lambda s, d: docs(s, d).select("doc_id", L.heading_level(F.concat(F.array_join(F.slice(F.array(F.lit("3"), F.lit("1"), F.lit("4")), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), "."), F.lit(" "), F.split("text", "\n")[0])).alias("level")),
    "toc_tail": lambda s, d: docs(s, d).select("doc_id", L.toc_tail(F.concat(F.split("text", "\n")[0], F.lit(" .... "), F.col("doc_id"))).alias("t")).select("doc_id", "t.*"),
    "toc_title": lambda s, d: docs(s, d).select("doc_id", L.toc_title(F.split("text", "\n")[0]).alias("title")),
    "line_blocks": lambda s, d: L.blocks(kinds(s, d)),
    "needs_translation": lambda s, d: L.numbered_lines(docs(s, d)).select("doc_id", "line_no", needs_translation(F.col("line")).alias("needed")),
    "translatable_lines": lambda s, d: L.translatable(kinds(s, d)).select("doc_id", "line_no", "kind"),
    "cache_miss": lambda s, d: R.cache_misses(L.translatable(kinds(s, d)), cache(s, d)).select("key"),
    "backfill": lambda s, d: R.back_filled(L.numbered_lines(docs(s, d)), cache(s, d)).select("doc_id", "line_no", F.sha2("out", 256).alias("digest")),
    "translation_batches": lambda s, d: R.batches(L.translatable(kinds(s, d))),
    "marker_split": lambda s, d: L.numbered_lines(docs(s, d)).select("doc_id", "line_no", R.marker_split(F.col("line")).alias("m")).select("doc_id", "line_no", F.length("m.mark").alias("mark"), F.sha2("m.body", 256).alias("body")),
    "protect_restore": lambda s, d: docs(s, d).select("doc_id", (R.restored(R.protected(F.col("text"))) == F.col("text")).alias("same"), F.sha2(R.protected(F.col("text")), 256).alias("digest")),
    "toc_parent": lambda s, d: L.toc_parents(nested(s, d)),
    "chapter_spans": lambda s, d: L.chapter_spans(titles(s, d), P.books(pages(s, d))),
    "monotone_outline": lambda s, d: L.monotone(outline(s, d)),
    "toc_near": lambda s, d: L.toc_near(contents(s, d), pages(s, d).withColumn("flat", squashed(F.col("text")))),
    "token_missing": lambda s, d: T.missing_tokens(layer(s, d), docs(s, d), "item_id", "doc_id"),
    "token_extra": lambda s, d: T.missing_tokens(docs(s, d), layer(s, d), "doc_id", "item_id"),
    "layer_diff": lambda s, d: T.layer_diff(diff_pairs(s, d)),
    "drop_furniture": lambda s, d: docs(s, d).select("doc_id", F.sha2(T.drop_furniture(F.col("text")), 256).alias("digest")),
    "guarded_replace": lambda s, d: E.guarded_replace(docs(s, d), "thing", "THING", 2).select("doc_id", "hits", "status", F.sha2("new_text", 256).alias("digest")),
    "image_dedup": lambda s, d: K.image_choice(table(s, d, "documents").select(F.concat("source", F.lit(".png")).alias("name"), F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("ord"))).select("ord", "stored_as"),
    "packed_chapters": lambda s, d: C.packed_chapters(pages(s, d).select("book_id", F.col("page_no").alias("seq"), (F.col("doc_id") % 9 + 1).alias("n_pages")), 20),
    "outline_lines": lambda s, d: C.outline_lines(headings(s, d).select("book_id", F.col("line_no").alias("seq"), "title"), headings(s, d).select("book_id", "line_no", "title")),
    "rendered_blocks": lambda s, d: C.rendered_blocks(L.blocks(kinds(s, d)), L.numbered_lines(spread_docs(s, d))).select("doc_id", "start_line", F.sha2("html", 256).alias("digest")),
    "chapters": lambda s, d: C.chapters(C.rendered_blocks(L.blocks(kinds(s, d)), L.numbered_lines(spread_docs(s, d))), docs(s, d).select("doc_id", F.left("text", F.lit(30)).alias("title"))).select("doc_id", F.length("xhtml").alias("n_chars")),
    "toc_levels": lambda s, d: C.toc_levels(nested(s, d).withColumn("part_level", F.col("toc") % 2 + 1)),
    "inline_markup": lambda s, d: docs(s, d).select("doc_id", F.sha2(C.inline(F.col("text")), 256).alias("digest")),
    "fingerprint": lambda s, d: table(s, d, "documents").select("doc_id", S.fingerprint(["doc_id", "lang", "source"]).alias("fingerprint")),
}

_LINES = "dl AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_HITS = lambda c: f"len(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains([{', '.join(map(quoted, L.PROSE_WORDS))}], w)))"
_SCORE = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '[A-Za-z]{{2,}}')) < 8 THEN 0 WHEN {_HITS(c)} >= 4 AND regexp_matches({c}, '[.:;)\\]]$') THEN 2 WHEN {_HITS(c)} >= 6 THEN 1 ELSE 0 END"
_TITLE = f"regexp_extract(s, {quoted(L.HEADING)}, 2)"
_KIND = f"""CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^(<table|<div|</div)') OR regexp_matches(s, {quoted(L.IMAGE)}) THEN 'html'
WHEN starts_with(s, '$$') OR ends_with(s, '$$') THEN 'math' WHEN regexp_matches(s, {quoted(L.BULLET)}) THEN 'bullet'
WHEN regexp_matches(s, {quoted(L.HEADING)}) THEN CASE WHEN regexp_matches({_TITLE}, {quoted(L.COMMAND_HEADING)}) OR (regexp_matches({_TITLE}, '^[a-z][\\w-]*\\s+.*\\s-\\w') AND {_HITS(_TITLE)} = 0) THEN 'code' ELSE 'heading' END
WHEN score >= 2 THEN 'prose' WHEN {any_sql('s', L.STRONG)} THEN 'code' WHEN score >= 1 THEN 'prose'
WHEN {any_sql('s', L.CONTAINS)} OR (regexp_matches(s, {quoted(L.TOKEN)}) AND length(s) >= 8 AND regexp_matches(s, '[_./$(]')) OR {any_sql('s', L.MEDIUM)} THEN 'code' ELSE 'prose' END"""
_KINDS = f"{_LINES}, sl AS (SELECT doc_id, line_no, line, {us('line')} AS s FROM dl), sc AS (SELECT *, {_SCORE('s')} AS score FROM sl), k AS (SELECT doc_id, line_no, line, s, {_KIND} AS kind FROM sc)"
_NEED = "len(regexp_extract_all(line, '[A-Za-z]')) >= 4"
_TL = f"{_KINDS}, tl AS (SELECT * FROM k WHERE kind IN ('prose', 'heading', 'bullet') AND {_NEED})"
_KEY = "sha256('en>zh|default||' || line)"
_TOK = lambda rel, key: f"SELECT {key} AS key, regexp_replace(t, '^[._\\-$#]+|[._\\-$#]+$', '', 'g') AS token FROM (SELECT {key}, unnest(regexp_extract_all(lower(regexp_replace(text, {quoted(T.TAG)}, ' ', 'g')), {quoted(T.TOKEN)})) AS t FROM {rel})"
_NOISE = ", ".join(map(quoted, T.NOISE))
_TOKENS = f"a AS ({_TOK('documents', 'doc_id')}), b AS ({_TOK('benchmark', 'item_id')})"
_MISSING = lambda x, y: f"WITH {_TOKENS} SELECT token, count(*) AS n, min(key) AS first FROM {x} WHERE length(token) >= 3 AND token NOT IN ({_NOISE}) AND token NOT IN (SELECT token FROM {y} WHERE length(token) >= 3) GROUP BY 1"
_DEF = f"(regexp_matches(s, {quoted(L.COMMAND_LINE)}) OR {any_sql('s', L.CONTAINS)} OR {any_sql('s', L.STRONG)})"
_BODY = "regexp_extract(line, '^(\\s*(?:#{1,6}|[-•·☐□])\\s+)(.*)$', 2)"
_PROT = "regexp_replace(regexp_replace(text, '`([^`]+)`', '<keep k=\"c\">\\1</keep>', 'g'), '\\$([^$]+)\\$', '<keep k=\"m\">\\1</keep>', 'g')"

_EDITS = r"""WITH e AS (SELECT doc_id AS book_id, doc_id % 5 AS op, text, CASE doc_id % 5 WHEN 1 THEN regexp_extract(text, '([A-Za-z]+)\s+[A-Za-z]', 1) WHEN 4 THEN regexp_extract(text, '([A-Za-z]+)', 1) ELSE regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1) END AS f, regexp_extract(text, '[A-Za-z]+\s+([A-Za-z]+)', 1) AS h FROM documents),
n AS (SELECT *, CASE WHEN f = '' THEN 0 ELSE (length(text) - length(replace(text, f, ''))) // length(f) END AS n, len(regexp_extract_all(text, '[0-9]+')) AS digits, instr(text, f) AS p FROM e),
j AS (SELECT *, substr(text, p + length(f)) AS rest, string_split(substr(text, p + length(f)), chr(10)) AS l FROM n),
k AS (SELECT *, CASE WHEN regexp_replace(l[1], '^\s+', '') <> '' THEN regexp_replace(l[1], '^\s+', '') ELSE regexp_replace(coalesce(l[2], ''), '^\s+', '') END AS follows FROM j),
s AS (SELECT *, CASE op WHEN 0 THEN CASE WHEN contains(text, '[added]') THEN 'skipped' WHEN n = 1 THEN 'done' ELSE 'found ' || n || ' times' END
  WHEN 1 THEN CASE WHEN n <> 1 THEN 'found ' || n || ' times' WHEN regexp_matches(l[1], '^\S') THEN 'skipped' WHEN starts_with(follows, left(h, 40)) THEN 'done' ELSE 'other text follows' END
  WHEN 2 THEN CASE WHEN n = 0 AND contains(text, '[new]') THEN 'skipped' WHEN n = 1 THEN 'done' ELSE 'found ' || n || ' times' END
  WHEN 3 THEN CASE WHEN digits = 0 THEN 'skipped' ELSE 'done' END
  ELSE CASE WHEN n = 0 THEN 'skipped' WHEN n >= 2 THEN 'done' ELSE 'found ' || n || ' times' END END AS status FROM k),
t AS (SELECT *, CASE op WHEN 0 THEN replace(text, f, f || chr(10) || chr(10) || '[added]') WHEN 1 THEN left(text, p + length(f) - 1) || ' ' || regexp_replace(rest, '^\s+', '')
  WHEN 2 THEN replace(text, f, '[new]') WHEN 3 THEN regexp_replace(text, '[0-9]+', '#', 'g')
  ELSE left(text, p + length(f) - 1 + instr(rest, f) - 1) || chr(10) || chr(10) || substr(rest, instr(rest, f) + length(f)) END AS new FROM s)
SELECT book_id, status, sha256(CASE WHEN book_id % 3 <> 0 AND status = 'done' THEN new ELSE text END) AS digest FROM t"""

SQL = {
    "edited_texts": _EDITS,
    "outline_lines": f"WITH RECURSIVE {BP}, h AS (SELECT book_id, page_no AS line_no, regexp_replace(lower(left(text, 40)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM bp), m AS MATERIALIZED (SELECT a.book_id, a.line_no AS seq, b.line_no FROM h a JOIN h b ON a.book_id = b.book_id AND a.k <> '' AND b.k <> '' AND (a.k = b.k OR (length(a.k) > 12 AND (contains(a.k, b.k) OR contains(b.k, a.k))) OR (left(a.k, 8) = left(b.k, 8) AND length(a.k) >= 8 AND abs(length(a.k) - length(b.k)) < 12))), f(book_id, seq, line_no, last) AS (SELECT DISTINCT book_id, 0::BIGINT, NULL::BIGINT, -1::BIGINT FROM h UNION ALL SELECT f.book_id, h.line_no, n.at, coalesce(n.at, f.last) FROM f JOIN h ON h.book_id = f.book_id AND h.line_no = f.seq + 1, LATERAL (SELECT min(m.line_no) AS at FROM m WHERE m.book_id = f.book_id AND m.seq = f.seq + 1 AND m.line_no > f.last) n) SELECT book_id, seq, line_no FROM f WHERE seq > 0",
    "translation_batches": f"WITH RECURSIVE {_TL}, t AS MATERIALIZED (SELECT doc_id, line_no, strlen(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM tl), f AS (SELECT doc_id, line_no, i, 0 AS batch, n AS used FROM t WHERE i = 1 UNION ALL SELECT t.doc_id, t.line_no, t.i, batch + (used + n > 5500)::INT, CASE WHEN used + n > 5500 THEN n ELSE used + n END FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1) SELECT doc_id, line_no, batch FROM f",
    "line_kind": f"WITH {_KINDS} SELECT doc_id, line_no, kind FROM k",
    "prose_score": f"WITH {_LINES} SELECT doc_id, line_no, {_SCORE('line')} AS score FROM dl",
    "block_is_code": f"WITH b AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {us('x')} <> '') AS l FROM documents), h AS (SELECT doc_id, l, len(list_filter(l, lambda x: regexp_matches(x, {quoted(L.CODE_LINE)}) OR regexp_matches(x, {quoted(L.ASM_LINE)}))) AS hits FROM b) SELECT doc_id, CASE WHEN len(l) = 0 THEN false WHEN len(l) = 1 THEN regexp_matches(l[1], {quoted(L.CODE_START)}) AND hits = 1 ELSE hits >= greatest(2, floor(len(l) * 0.6)) END AS is_code FROM h",
    "heading_level": "WITH t AS (SELECT doc_id, array_to_string(['3', '1', '4'][1:doc_id % 3 + 1], '.') || ' ' || string_split(text, chr(10))[1] AS title FROM documents), n AS (SELECT *, regexp_extract(title, '^((?:\\d+|[A-Z])(?:\\.(?:\\d+|\\w+))*)[\\s.、]', 1) AS num FROM t) SELECT doc_id, CASE WHEN regexp_matches(title, '^[A-Z][A-Z0-9]{1,6}(\\s|$)') AND NOT regexp_matches(title, '[\\x{4e00}-\\x{9fff}]') THEN NULL WHEN num <> '' AND len(regexp_extract_all(num, '\\.')) = 1 THEN 2 WHEN num <> '' AND len(regexp_extract_all(num, '\\.')) >= 2 THEN 3 ELSE 4 END AS level FROM n",
    "toc_tail": f"WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] || ' .... ' || doc_id AS line FROM documents) SELECT doc_id, regexp_extract(line, {quoted(L.TOC_TAIL)}, 1) AS title, regexp_extract(line, {quoted(L.TOC_TAIL)}, 2) AS page FROM t",
    "toc_title": "WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents) SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(x, '\\$\\s*[^$]*\\$\\s*', '', 'g'), '\\s{2,}', ' ', 'g')), ''), x) AS title FROM t",
    "line_blocks": f"WITH {_KINDS}, nb AS (SELECT *, lag(kind) OVER w AS pk, lag(line_no) OVER w AS pl, {_DEF} AS hard FROM k WHERE kind <> 'blank' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), isl AS (SELECT *, sum((pk IS NULL OR pk <> kind OR kind IN ('heading', 'math', 'html') OR (kind = 'prose' AND pl < line_no - 1))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM nb) SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, CASE WHEN kind = 'code' AND count(*) = 1 AND NOT bool_or(hard) THEN 'prose' WHEN kind = 'bullet' THEN 'bullets' ELSE kind END AS kind, count(*) AS n_lines FROM isl GROUP BY doc_id, island, isl.kind",
    "needs_translation": f"WITH {_LINES} SELECT doc_id, line_no, {_NEED} AS needed FROM dl",
    "translatable_lines": f"WITH {_TL} SELECT doc_id, line_no, kind FROM tl",
    "cache_miss": f"WITH {_TL} SELECT DISTINCT {_KEY} AS key FROM tl WHERE line NOT IN (SELECT line FROM tl WHERE doc_id % 3 = 0)",
    "backfill": f"WITH {_TL}, c AS (SELECT DISTINCT line FROM tl WHERE doc_id % 3 = 0) SELECT doc_id, line_no, sha256(CASE WHEN c.line IS NOT NULL THEN 'zh: ' || dl.line ELSE dl.line END) AS digest FROM dl LEFT JOIN c ON c.line = dl.line",
    "marker_split": f"WITH {_LINES} SELECT doc_id, line_no, CASE WHEN len(regexp_extract_all({_BODY}, '[A-Za-z]')) >= 4 THEN length(regexp_extract(line, '^(\\s*(?:#{{1,6}}|[-•·☐□])\\s+)(.*)$', 1)) ELSE 0 END AS mark, sha256(CASE WHEN len(regexp_extract_all({_BODY}, '[A-Za-z]')) >= 4 THEN {_BODY} ELSE line END) AS body FROM dl",
    "protect_restore": f"SELECT doc_id, regexp_replace(regexp_replace({_PROT}, '<keep k=\"c\">(.*?)</keep>', '`\\1`', 'g'), '<keep k=\"m\">(.*?)</keep>', '$\\1$', 'g') = text AS same, sha256({_PROT}) AS digest FROM documents",
    "toc_parent": "WITH e AS (SELECT conv_id AS toc, turn AS seq, 1 + length(text) % 3 AS level FROM conversations) SELECT a.toc, a.seq, a.level, max(b.seq) AS parent_seq FROM e a LEFT JOIN e b ON a.toc = b.toc AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2, 3",
    "chapter_spans": f"WITH {BK} SELECT b.book_id, page_no AS start_page, coalesce(lead(page_no) OVER (PARTITION BY b.book_id ORDER BY page_no) - 1, page_count) AS end_page, string_split(text, chr(10))[1] AS title FROM bp b JOIN bk USING (book_id) WHERE regexp_matches(string_split(text, chr(10))[1], '^[A-M]')",
    "monotone_outline": f"WITH {BP}, o AS (SELECT book_id, page_no AS seq, doc_id * 7919 % 101 AS page FROM bp), m AS (SELECT *, max(page) OVER (PARTITION BY book_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM o) SELECT book_id, seq, page FROM m WHERE most IS NULL OR page > most",
    "toc_near": f"WITH {BP}, f AS (SELECT *, {squashed_sql('text')} AS flat FROM bp), t AS (SELECT book_id, page_no AS seq, page_no + doc_id % 3 - 1 AS page, left(flat, 20) AS key FROM f) SELECT t.book_id, seq, page, (SELECT f.page_no FROM f WHERE f.book_id = t.book_id AND abs(f.page_no - t.page) <= 1 AND contains(f.flat, t.key) ORDER BY abs(f.page_no - t.page), f.page_no LIMIT 1) AS found_page FROM t",
    "token_missing": _MISSING("b", "a"),
    "token_extra": _MISSING("a", "b"),
    "drop_furniture": "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS full_ FROM l) SELECT doc_id, sha256(CASE WHEN len(full_) < 3 THEN text ELSE array_to_string(l[full_[1] + 1 : full_[-1] - 1], chr(10)) END) AS digest FROM f",
    "guarded_replace": "SELECT doc_id, len(regexp_extract_all(text, 'thing')) AS hits, CASE len(regexp_extract_all(text, 'thing')) WHEN 0 THEN 'skipped' WHEN 2 THEN 'applied' ELSE 'refused' END AS status, sha256(CASE WHEN len(regexp_extract_all(text, 'thing')) = 2 THEN replace(text, 'thing', 'THING') ELSE text END) AS digest FROM documents",
    "image_dedup": "WITH i AS (SELECT source || '.png' AS name, source, sha256(text) AS digest, doc_id AS ord FROM documents), g AS (SELECT name, source, digest, min(ord) AS o FROM i GROUP BY name, source, digest), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS nth FROM g) SELECT ord, CASE WHEN nth = 1 THEN f.name ELSE f.source || '_' || nth || '.png' END AS stored_as FROM i JOIN f USING (name, digest)",
    "packed_chapters": f"WITH RECURSIVE {BP}, c AS (SELECT book_id, page_no AS seq, doc_id % 9 + 1 AS n FROM bp), f AS (SELECT book_id, seq, 0 AS part, n AS used FROM c WHERE seq = 1 UNION ALL SELECT c.book_id, c.seq, part + (used + n > 20)::INT, CASE WHEN used + n > 20 THEN n ELSE used + n END FROM f JOIN c ON c.book_id = f.book_id AND c.seq = f.seq + 1) SELECT book_id, seq, part FROM f",
    "toc_levels": "SELECT conv_id AS toc, turn AS seq, 1 + length(text) % 3 AS level, conv_id % 2 + 1 AS part_level, conv_id % 2 + 1 + length(text) % 3 AS book_level FROM conversations",
    "inline_markup": "WITH t AS (SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`([^`]+)`', '<code>\\1</code>', 'g') AS c, len(regexp_extract_all(text, '\\$')) AS n FROM documents) SELECT doc_id, sha256(CASE WHEN n % 2 = 0 THEN regexp_replace(c, '\\$([^$]+)\\$', '<code class=\"math\">\\1</code>', 'g') ELSE c END) AS digest FROM t",
    "fingerprint": "SELECT doc_id, left(sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 16) AS fingerprint FROM documents",
}
