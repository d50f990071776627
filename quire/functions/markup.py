"""Expressions on markup, LaTeX and paths. Java's regular expressions; what is a fixed value is marked so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import entities_escaped, ustrip

# Named references of parsed formulas and what stands for them there.
ENTITIES = {"&#x27;": "'", "&#39;": "'", "&apos;": "'", "&quot;": '"', "&#x22;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": "~", "&times;": r"\times", "&minus;": "-", "&plusmn;": r"\pm"}
#: Fixed value: what makes a formula a listing.
ASM_HINT = r"//|\bassign\b|\bendcase\b|\bcasez?\b|1'b[01x]|0x[0-9a-fA-F]"
# Commands of a formula that stand for a character in a listing; all others stand for a blank.
COMMANDS = {r"\prime": "'", r"\rightarrow": "→", r"\leftarrow": "←"}
#: Environments with an argument for their columns, and commands that only set a font.
GRIDS, FONTS = "array|aligned|alignedat|matrix|tabular", "mathrm|text|textsf|mathbf|mathtt|mathit"
#: The tokens of a formula, by kind: environments, a prime, a font before its group, commands, escapes, marks, and plain text.
LISTING_TOKEN = rf"\\begin\s*\{{(?:{GRIDS})\}}\s*\{{[^{{}}]*\}}|\\(?:begin|end)\s*\{{[^{{}}]*\}}|\^\{{\\prime\}}|\\(?:{FONTS})\s*(?=\{{[^{{}}]*\}})|\\(?:prime|rightarrow|leftarrow)|\\[a-zA-Z]+|\\[^a-zA-Z]|[~&{{}}]|[^\\~&{{}}^]+|."
#: Blanks that a listing doesn't have: inside brackets, between letters that stand apart, and at the ends of lines.
NO_BLANKS = r"(?m)(?<=[\[(])\s+|\s+(?=[\])])|(?<=(?<![A-Za-z0-9])[A-Za-z0-9]) (?=[A-Za-z0-9](?![A-Za-z0-9]))|^[ \t]+|[ \t]+$"
#: Fixed value: tags of inline markup that are kept in a text that is escaped otherwise.
KEPT_TAG = r"</?(?:sup|sub|em|strong)>|<br\s*/?>"
#: Fixed value: attributes without quotes in parsed tables.
BARE_ATTRIBUTE = r"\b(border|rowspan|colspan|width|height)=(\d+%|\d+\.?\d*%\d*|\d+)"
#: Fixed value: the sentence that marks a sample chapter.
SAMPLE_MARKER = "这是样例章节，用来说明文件应该长什么样"


def context(text: Column, at: Column, width: int = 28) -> Column:
    """The characters around a position (from 0), line breaks as spaces."""
    start = F.greatest(F.lit(0), at - width)
    return F.replace(F.substring(text, start + 1, F.least(F.length(text), at + width) - start), F.lit("\n"), F.lit(" "))


def unescaped(latex: Column) -> Column:
    """Character references of a formula decoded: the fixed ones, then numbers, decimal or hexadecimal as they are written."""
    known = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), latex)
    parts = F.regexp_extract_all(known, F.lit(r"(?s)&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|[^&]+|&"), F.lit(0))

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(x.startswith("&#") & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    return F.when(known.contains("&#"), F.array_join(F.transform(parts, decoded), "")).otherwise(known)


def bare_amp_escaped(c: Column) -> Column:
    """Ampersands that begin no character reference, escaped."""
    return F.regexp_replace(c, r"&(?!#?\w+;)", "&amp;")


def is_asm_math(latex: Column) -> Column:
    """Whether a formula is a listing: by its words, or by a semicolon beside escaped hashes or line breaks."""
    return latex.rlike(ASM_HINT) | (latex.contains(";") & latex.rlike(r"\\#|\\\\"))


def listing(latex: Column) -> Column:
    """A listing that was read as a formula, as text; letters that stand apart are joined.

    The formula is cut into tokens once, and each stands for a text by its kind.
    """

    def meant(t: Column) -> Column:
        first, second = F.left(t, F.lit(1)), F.substring(t, 2, 1)
        command = F.when(t.rlike(rf"^\\(?:begin|end|{FONTS})\s*(?:\{{|$)") & ~t.rlike(r"^\\(?:begin|end)$"), "")
        for name, text in COMMANDS.items():
            command = command.when(t == name, text)
        escaped = F.when(second == "\\", "\n").when(second.rlike("[_%#]"), second).when(second.rlike("[&{}]"), "").when(second.rlike("[ ,;:!]"), " ").otherwise(t)
        return F.when(t == r"^{\prime}", "'").when((first == "\\") & second.rlike("[a-zA-Z]"), command.otherwise(" ")).when(first == "\\", escaped).when(t == "~", " ").when(t.rlike("^[&{}]$"), "").otherwise(t)

    tokens = F.regexp_extract_all(latex, F.lit(f"(?s){LISTING_TOKEN}"), F.lit(0))
    text = F.array_join(F.transform(tokens, meant), "")
    return ustrip(F.regexp_replace(F.regexp_replace(text, NO_BLANKS, ""), r"[ \t]{2,}", " "))


def escaped_but_inline(c: Column) -> Column:
    """Escaped text that keeps its inline tags."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){KEPT_TAG}|(?:(?!{KEPT_TAG}).)+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^(?:{KEPT_TAG})$"), x).otherwise(entities_escaped(x))), "")


def table_attributes(c: Column) -> Column:
    """A parsed table's markup with quoted attributes, and written-out line breaks as elements."""
    return F.replace(F.regexp_replace(c, BARE_ATTRIBUTE, '$1="$2"'), F.lit("\\n"), F.lit("<br/>"))


def issue_path(path: Column) -> Column:
    """A checker's path from the build's root: with slashes, cut before OEBPS/."""
    p = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "^/+", "")
    at = F.locate("OEBPS/", p)
    return F.when(at > 0, F.substr(p, at)).otherwise(p)


def simple_level(title: Column) -> Column:
    """The number of parts of a leading section number, else 1."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)(?!\w)", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def is_chapter_start(line: Column) -> Column:
    """A heading of the second order that begins no numbered section below a chapter."""
    return line.rlike(r"^##\s+\S") & ~line.rlike(r"^##\s+\d+(\.\d+)+\s+\S")


def label(language: Column, what: str) -> Column:
    """The fixed words of a navigation document: Chinese for Chinese books and unknown ones, else English."""
    zh, en = {"toc": ("目录", "Contents"), "cover": ("封面", "Cover"), "body": ("正文", "Body")}[what]
    return F.when(F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit("zh"))).startswith("zh"), zh).otherwise(en)


def is_written(chapter: Column) -> Column:
    """Whether a chapter's text is more than the sample."""
    return ~chapter.contains(SAMPLE_MARKER)


def page_orders(spec: Column) -> Column:
    """array<struct<page, ord>> of lists like "325:1，497": the order is 1 where none is given."""
    parts = F.filter(F.split(spec, r"[,，\s]+"), lambda p: p.rlike(r"^\d{1,9}(:\d{0,9})?$"))
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("page"), F.coalesce(F.nullif(F.split_part(p, F.lit(":"), F.lit(2)), F.lit("")).cast("int"), F.lit(1)).alias("ord")))
