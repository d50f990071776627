"""Lines of a text: kinds, blocks, headings and tables of contents.

Kinds are one cascade of built-in predicates. Word boundaries are written out with character classes, since \\b differs between
engines and treats accented letters in different ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import needs_translation, ustrip

END = r"($|[^\p{L}\p{N}_])"
# Lines that are listings or terminal sessions at first sight, in the order in which they are tried.
STRONG = (
    r"^#\s+\S",
    r"^%\s*\S",
    r"^\$\s+\S",
    r"^(bsc|c\+\+|cc|gc?make|make|setenv|export|exec|package\s+require|namespace\s+import|bluetcl|bsim|sim)" + END,
    r"^\(\*",
    r"^`[a-zA-Z]",
    r"^//",
    r"^(assign|wire|reg|input|output|module|endmodule|always|initial|begin|end|else|endcase|casez?|parameter|localparam|function|endfunction|task|endtask|interface|endinterface|typedef|import|rule|endrule|method|endmethod|actionvalue|endactionvalue|instance|endinstance|typeclass|endtypeclass|deriving|return|let|noinline|match|endmatch)" + END,
    r"^(if|else|for|while|switch|case)\s*[\(\{]",
    r"^\{",
    r"^\}",
    r"^[A-Za-z_][\w$\[\]\.]*\s*(<=|=|->|<-)\s*\S",
)
# What makes a line code wherever it stands.
CONTAINS = (
    r"^[\w./-]+\.(bsv|ba|bo|v|vcd|so|o|h|c|cxx|cpp|tcl)" + END,
    r"(^|[^\p{L}\p{N}_])exec:\s",
    r"(^|[^\p{L}\p{N}_])[A-Z][A-Za-z]+ (object|file|module|library) created:",
    r"#\(",
    "<-",
    r"::\s*\*",
    r"^\s*\.[A-Za-z_]\w*\s*\(",
)
# What a line must hold to match; where that is all there is to a pattern, it isn't tried.
LITERALS = {CONTAINS[1]: "exec:", CONTAINS[2]: " created:", CONTAINS[3]: "#(", CONTAINS[4]: "<-", CONTAINS[5]: "::"}
WHOLE = {CONTAINS[3], CONTAINS[4]}
# Weaker signs. A single token must also be long and look technical.
TOKEN = r"^[A-Za-z_][\w$.{}\[\]<>:/+-]*$"
MEDIUM = (
    r";\s*$",
    r"^[A-Za-z][\w$]*\s*\([^)]*\)\s*[;.]?$",
    r"^[\w.]+\.(bsv|ba|bo|v|vcd|so|o|h|c|cxx|cpp|exe|tcl|mk|dot)" + END,
    r"(?i)^(File|Simulation|Bluesim|SystemC|Verilog|Foreign|User|Elaborated|code generation)" + END,
    r"^[A-Za-z_][\w$]*\s+\S+\s+[A-Za-z_][\w$]*\s*$",
)
# Marks of bullets, headings, images, command lines and contents lines.
BULLET = r"^([•·]\s*|-\s+|☐\s*|□\s*)"
HEADING = r"^(#{1,6})\s+(.*)$"
IMAGE = r"^!\[[^\]]*\]\([^)]*\)"
COMMAND_HEADING = r"^((bsc|c\+\+|cc|make|setenv|export|exec|package\s+require|namespace\s+import|sim|bsim|bluetcl)|#\s|\.\.\.|--?\w+" + END + ")"
COMMAND_LINE = r"^([#$%]\s+)?(bsc|c\+\+|cc|make|setenv|export|exec|package|namespace|sim|bsim|bluetcl)" + END
# Fixed value: words of running text.
PROSE_WORDS = "the this that these those is are was were be been will would can could should may might must you your we our it its if when then than which where while for with from into about there have has had do does did not but and or so as at by in of on to".split()
TOC_TAIL = r"^(.*?)[\s.．]*(\d+(?:[-–]\d+)?(?:\s*,\s*\d+(?:[-–]\d+)?)*)\s*$"


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found.

    Anchored ones are one alternation behind a common anchor, so that a matcher that fails at the start stops there. The others are
    looked for one after the other; those that ask for a literal only where it is.
    """
    at_start = [p.removeprefix("^") for p in patterns if p.startswith("^") and "|^" not in p]
    found = c.rlike("^(?:" + "|".join(f"(?:{p})" for p in at_start) + ")") if at_start else F.lit(False)
    for p in patterns:
        if not p.startswith("^"):
            found = found | (c.contains(LITERALS[p]) if p in WHOLE else c.contains(LITERALS[p]) & c.rlike(p) if p in LITERALS else c.rlike(p))
    return found


def _factored(words: list[str]) -> str:
    """The words as a pattern that tries only those with the right first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())


#: One of the words of running text, in a lower-case line.
PROSE_WORD = rf"(?<![\p{{L}}\p{{N}}_])(?:{_factored(PROSE_WORDS)})(?![\p{{L}}\p{{N}}_])"


def prose_hits(c: Column) -> Column:
    """How many of the line's words are words of running text."""
    return F.regexp_count(F.lower(c), F.lit(PROSE_WORD))


def _at_least(c: Column, pattern: str, n: int) -> Column:
    """Whether the pattern is found n times. The line is read to the n-th place only; no place is tried twice."""
    return c.rlike(rf"^(?>(?s:.*?)(?:{pattern})){{{n}}}")


def prose_score(c: Column) -> Column:
    """2 for clear running text, 1 for probable, else 0; under eight words always 0."""
    low = F.lower(c)
    many = F.when(c.rlike(r"[.:;)\]]$"), F.when(_at_least(low, PROSE_WORD, 4), 2).otherwise(0)).when(_at_least(low, PROSE_WORD, 6), 1).otherwise(0)
    return F.when(_at_least(c, "[A-Za-z]{2,}+", 8), many).otherwise(0)


def is_command_heading(title: Column) -> Column:
    return title.rlike(COMMAND_HEADING) | (title.rlike(r"^[a-z][\w-]*\s+.*\s-\w") & (prose_hits(title) == 0))


def is_definitely_code(c: Column) -> Column:
    return _any(c, (COMMAND_LINE, *CONTAINS, *STRONG))


def line_kind(line: Column) -> Column:
    """blank, html, math, bullet, heading, code or prose. In a table of lines, `kinds` strips and scores each line once."""
    s = ustrip(line)
    return F.coalesce(_plain_kind(s), _kind_by_score(s, prose_score(s)))


def _plain_kind(s: Column) -> Column:
    """The kind of a stripped line that needs no score, else null."""
    heading = F.when(is_command_heading(F.regexp_extract(s, HEADING, 2)), "code").otherwise("heading")
    return (
        F.when(s == "", "blank")
        .when(s.startswith("<table") | s.startswith("<div") | s.startswith("</div") | (s.startswith("![") & s.rlike(IMAGE)), "html")
        .when(s.startswith("$$") | s.endswith("$$"), "math")
        .when(F.left(s, F.lit(1)).isin(*"•·☐□") | (s.startswith("-") & s.rlike(BULLET)), "bullet")
        .when(s.startswith("#") & s.rlike(HEADING), heading)
    )


def _kind_by_score(s: Column, score: Column) -> Column:
    token = s.rlike(TOKEN) & (F.length(s) >= 8) & s.rlike(r"[_./$(]")
    weak = F.when(_any(s, CONTAINS) | token | _any(s, MEDIUM), "code").otherwise("prose")
    return F.when(score >= 2, "prose").when(_any(s, STRONG), "code").when(score >= 1, "prose").otherwise(weak)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), 1-based."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, kind)."""
    s = F.col("__s")
    rows = numbered_lines(docs).withColumn("__s", ustrip(F.col("line"))).withColumn("__kind", _plain_kind(s))
    rows = rows.withColumn("__score", F.when(F.col("__kind").isNull(), prose_score(s)))
    # What asks for the kind behind this would be tried before it, with all patterns again; a generator stops that.
    kind = F.explode(F.array(F.coalesce("__kind", _kind_by_score(s, F.col("__score")))))
    return rows.select("doc_id", "line_no", "line", kind.alias("kind"))


def blocks(kinds: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, kind, n_lines) of runs of lines of a kind.

    Blank lines inside code and between bullets don't end a block, but end one of prose. Headings, math and html lines stand
    alone. A single code line without hard evidence is prose. Islands come from one window over the non-blank lines.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    k = kinds.where("kind <> 'blank'")
    before, line = F.lag("kind").over(order), F.lag("line_no").over(order)
    new = before.isNull() | (before != F.col("kind")) | F.col("kind").isin("heading", "math", "html") | ((F.col("kind") == "prose") & (line < F.col("line_no") - 1))
    # Only single code lines need the hard evidence; the lines themselves go no further.
    k = k.select("doc_id", "line_no", "kind", F.when(F.col("kind") == "code", is_definitely_code(ustrip(F.col("line")))).otherwise(False).alias("hard"))
    k = k.withColumn("island", F.sum(new.cast("int")).over(order))
    b = k.groupBy("doc_id", "island", "kind").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), F.max("hard").alias("hard"))
    kind = F.when((F.col("kind") == "code") & (F.col("n_lines") == 1) & ~F.col("hard"), "prose").when(F.col("kind") == "bullet", "bullets").otherwise(F.col("kind"))
    return b.select("doc_id", "start_line", "end_line", kind.alias("kind"), "n_lines")


# First lines, and lines, of listings in books on hardware and programming.
CODE_START = r"^\s*((assign|always|endcase|end|begin|else|module|function|input|output)" + END + r"|case[z]?\s*\(|if\s*\(|for\s*\(|\d+'[bodhBODH]|always@)"
CODE_LINE = r"^\s*(\d+'[bodhBODH]|[A-Za-z_][\w.]*\s*=|(assign|end|endcase|case[z]?|else)" + END + r"|//|/\*|\*/|if\s*\(|for\s*\(|\}|\{|\)\s*;|[A-Z]{2,6}\s+[Rr]\d)"
ASM_LINE = r"^\s*([A-Z][A-Z0-9.]*\s+[Rr]\d|LDM|STM|[a-z]{2,6}\s+[A-Z]?\d+" + END + ")"


def block_is_code(block: Column) -> Column:
    """At least 60 % of the non-blank lines, and two of them, look like code; a single line must begin like code too."""
    ls = F.filter(F.split(block, "\n"), lambda x: ustrip(x) != "")
    hits = F.size(F.filter(ls, lambda x: x.rlike(CODE_LINE) | x.rlike(ASM_LINE)))
    n = F.size(ls)
    return F.when(n == 0, False).when(n == 1, F.element_at(ls, 1).rlike(CODE_START) & (hits == 1)).otherwise(hits >= F.greatest(F.lit(2), F.floor(n * 0.6)))


def heading_level(title: Column) -> Column:
    """2 to 4 by the parts of a leading number; null for an upper-case mnemonic, which is code. The patterns are fixed values."""
    number = F.regexp_extract(title, r"^((?:\d+|[A-Z])(?:\.(?:\d+|\w+))*)[\s.、]", 1)
    dots = F.regexp_count(number, F.lit(r"\."))
    code = title.rlike(r"^[A-Z][A-Z0-9]{1,6}(\s|$)") & ~title.rlike(r"[\x{4e00}-\x{9fff}]")
    return F.when(code, None).when((number != "") & (dots == 1), 2).when((number != "") & (dots >= 2), 3).otherwise(4)


def toc_tail(line: Column) -> Column:
    """struct<title, page> of a printed contents line, both empty if it ends without a page."""
    return F.struct(F.regexp_extract(line, TOC_TAIL, 1).alias("title"), F.regexp_extract(line, TOC_TAIL, 2).alias("page"))


def toc_title(title: Column) -> Column:
    """A heading without math and doubled spaces; as it is if nothing would be left. The patterns are fixed values."""
    short = F.trim(F.regexp_replace(F.regexp_replace(title, r"\$\s*[^$]*\$\s*", ""), r"\s{2,}", " "))
    return F.coalesce(F.nullif(short, F.lit("")), title)


def toc_parents(entries: DataFrame) -> DataFrame:
    """Entries (toc, seq, level) with parent_seq: the nearest one before with a smaller level.

    An entry asks each smaller level of its contents for its last position so far: a running maximum for each contents and
    level. Levels may be any numbers; a table of contents has few.
    """
    levels = entries.groupBy("toc").agg(F.collect_set("level").alias("__levels"))
    at = entries.join(levels, "toc").select("toc", "seq", F.explode(F.filter("__levels", lambda x: x < F.col("level"))).alias("__below"))
    marks = entries.select("toc", "seq", F.col("level").alias("__below"), F.lit(True).alias("__mark"))
    asks = at.select("toc", "seq", "__below", F.lit(False).alias("__mark"))
    by = Window.partitionBy("toc", "__below").orderBy("seq", "__mark").rowsBetween(Window.unboundedPreceding, -1)
    last = marks.unionByName(asks).withColumn("__last", F.max(F.when(F.col("__mark"), F.col("seq"))).over(by)).where("not __mark")
    parents = last.groupBy("toc", "seq").agg(F.max("__last").alias("parent_seq"))
    return entries.join(parents, ["toc", "seq"], "left")


def chapter_spans(starts: DataFrame, counts: DataFrame) -> DataFrame:
    """(book_id, start_page, end_page, title): a chapter ends before the next one, the last with the book."""
    order = Window.partitionBy("book_id").orderBy("start_page")
    s = starts.withColumn("next", F.lead("start_page").over(order)).join(counts.select("book_id", "page_count"), "book_id")
    return s.select("book_id", "start_page", F.coalesce(F.col("next") - 1, F.col("page_count")).alias("end_page"), "title")


def monotone(entries: DataFrame) -> DataFrame:
    """Entries (book_id, seq, page) whose page lies behind all pages before: the greedy rule as a running maximum."""
    before = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("most", F.max("page").over(before)).where("most is null or page > most").drop("most")


def toc_near(toc: DataFrame, pages: DataFrame, around: int = 1) -> DataFrame:
    """(book_id, seq, page, found_page) of contents entries (book_id, seq, page, key): the nearest page within around
    whose squashed text has the key, null if none. Each entry asks for 2 * around + 1 pages by an equal join.
    """
    asked = toc.withColumn("page_no", F.explode(F.sequence(F.col("page") - around, F.col("page") + around)))
    hit = asked.join(pages.select("book_id", "page_no", "flat"), ["book_id", "page_no"]).where(F.contains("flat", "key"))
    best = hit.groupBy("book_id", "seq").agg(F.min(F.struct(F.abs(F.col("page_no") - F.col("page")).alias("d"), "page_no")).alias("b"))
    return toc.join(best, ["book_id", "seq"], "left").select("book_id", "seq", "page", F.col("b.page_no").alias("found_page"))


def translatable(kinds: DataFrame) -> DataFrame:
    """Lines that are worth a translation: prose, headings and bullets with at least four ASCII letters."""
    return kinds.where(F.col("kind").isin("prose", "heading", "bullet")).where(needs_translation(F.col("line")))
