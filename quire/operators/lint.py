"""Checks of package documents. Every rule gives rows of one schema: issues(id, severity, message, path, line).

Rules on archive entries and on manifests are filters, counts and anti joins. Rules that need a parsed document go through
one pandas function over the entries, since Spark's xpath fails a whole job on malformed XML.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.shipping import ship

SEVERITIES = ("FATAL", "ERROR", "WARNING", "INFO")
# A line of a checker's text report, and the place in it.
CHECKER = r"^(FATAL|ERROR|WARNING|INFO|USAGE)\(([A-Za-z0-9_-]+)\):\s*(.*)$"
LOCATION = r"^(.*?)\((\d+),(\d+)\)$"
#: Schemes of remote references.
REMOTE = r"^(https?:|ftp:)?//"
ISSUE = "id string, severity string, message string, path string, line int"


def severity_rank(c: Column) -> Column:
    """0 for the gravest; unknown severities come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(c)), F.lit(0)) - 1, F.lit(9)).cast("int")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "id").agg(F.count("*").alias("n"))


def gate(issues: DataFrame, fail_on: str = "ERROR") -> DataFrame:
    """One row (n_blocking, passed): whether nothing is as grave as fail_on."""
    bad = F.count(F.when(severity_rank(F.col("severity")) <= SEVERITIES.index(fail_on), 1))
    return issues.agg(bad.alias("n_blocking"), (bad == 0).alias("passed"))


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group and how many more there are. A report; the limit is its feature."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    ranked = rows.withColumn("nth", F.row_number().over(w.orderBy(*order))).where(F.col("nth") <= n)
    return ranked.join(rows.groupBy(group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more")), group)


def excerpts(issues: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """(path, line, at_line, mark, text): the source lines around each issue. lines: path, line_no, text. An equal join: each issue
    asks for its lines by number."""
    asked = issues.select("path", "line").distinct().withColumn("at_line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)))
    got = asked.join(lines.select("path", F.col("line_no").alias("at_line"), "text"), ["path", "at_line"])
    return got.select("path", "line", "at_line", F.when(F.col("at_line") == F.col("line"), ">>").otherwise("  ").alias("mark"), "text")


def archive_issues(entries: DataFrame) -> DataFrame:
    """Issues of the archives themselves. entries: epub, ord, name, stored, content (binary)."""
    text = F.decode("content", "UTF-8")
    first = entries.where("ord = 0")
    wrong = lambda cond, severity, message: first.where(cond).select(F.lit("PKG-006").alias("id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.concat("epub", F.lit("!"), "name").alias("path"), F.lit(0).alias("line"))
    out = wrong(F.col("name") != "mimetype", "FATAL", "mimetype is not the first entry")
    out = out.unionAll(wrong((F.col("name") == "mimetype") & ~F.col("stored"), "ERROR", "mimetype is compressed"))
    out = out.unionAll(wrong((F.col("name") == "mimetype") & (text != "application/epub+zip"), "FATAL", "mimetype has other content"))
    # An archive that can't be read, or has nothing in it, is one row without a name.
    empty = lambda cond, rule, message: entries.where("name is null").where(cond).select(F.lit(rule), F.lit("FATAL"), F.lit(message), F.col("epub"), F.lit(0))
    out = out.unionAll(empty(F.col("content").isNotNull(), "PKG-001", "no zip archive")).unionAll(empty(F.col("content").isNull(), "PKG-006", "the archive is empty"))
    have = entries.where("name = 'META-INF/container.xml'").select("epub")
    lacking = entries.where("name is not null").select("epub").distinct().join(have, "epub", "left_anti")
    return out.unionAll(lacking.select(F.lit("PKG-002"), F.lit("FATAL"), F.lit("no META-INF/container.xml"), F.col("epub"), F.lit(0)))


def rootfile_issues(entries: DataFrame) -> DataFrame:
    """Whether each archive's container names a package document that is there. entries: epub, name, content."""
    box = entries.where("name = 'META-INF/container.xml'").select("epub", F.decode("content", "UTF-8").alias("text"))
    value = lambda a: F.regexp_extract("tag", rf"\s{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    tags = box.select("epub", F.regexp_extract("text", r"<(?:[\w.-]+:)?rootfile\b[^>]*>", 0).alias("tag"))
    at = tags.select("epub", "tag", value("full-path").alias("target"), value("media-type").alias("media_type"))
    have = entries.where("name is not null").select("epub", F.col("name").alias("target")).distinct().withColumn("there", F.lit(True))
    seen = at.join(have, ["epub", "target"], "left").withColumn("there", F.col("there") & (F.col("target") != ""))
    place = F.concat("epub", F.lit("!META-INF/container.xml"))
    issue = lambda rows, severity, message, path=place: rows.select(F.lit("PKG-003").alias("id"), F.lit(severity).alias("severity"), message.alias("message"), path.alias("path"), F.lit(0).alias("line"))
    out = issue(seen.where("tag = ''"), "FATAL", F.lit("no rootfile"))
    out = out.unionAll(issue(seen.where("tag <> '' and media_type <> 'application/oebps-package+xml'"), "ERROR", F.concat(F.lit("rootfile media type: "), "media_type")))
    out = out.unionAll(issue(seen.where("tag <> '' and there is null"), "FATAL", F.concat(F.lit("rootfile names a missing entry: "), "target")))
    # Without a rootfile that is there, the only package document of the archive counts; several or none can't be told apart.
    lost = entries.where("name is not null").groupBy("epub").agg(F.count(F.when(F.col("name").endswith(".opf"), 1)).alias("n")).join(seen.where("there").select("epub"), "epub", "left_anti")
    return out.unionAll(issue(lost.where("n <> 1"), "FATAL", F.lit("the package document can't be located"), F.col("epub")))


def manifest_target_issues(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Local manifest items (epub, opf, href) whose target is no entry of the archive."""
    asked = manifest.where(~F.col("href").rlike(REMOTE) & (F.col("href") != "")).withColumn("target", resolve(F.col("opf"), F.col("href")))
    missing = asked.join(entries.where("name is not null").select("epub", F.col("name").alias("target")), ["epub", "target"], "left_anti")
    return missing.select(F.lit("RSC-007").alias("id"), F.lit("ERROR").alias("severity"), F.concat(F.lit("the manifest names a missing file: "), "href").alias("message"), F.col("opf").alias("path"), F.lit(0).alias("line"))


def manifest_items(entries: DataFrame) -> DataFrame:
    """(epub, opf, href) of the package documents among the entries (epub, name, content)."""
    tags = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"<(?:[\w.-]+:)?item\s[^>]*>"), F.lit(0))
    items = entries.where(F.col("name").endswith(".opf")).select("epub", F.col("name").alias("opf"), F.explode(tags).alias("tag"))
    return items.select("epub", "opf", F.regexp_extract("tag", r"\shref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href")).where("href <> ''")


def checker_lines(reports: DataFrame) -> DataFrame:
    """(id, severity, message, path, line, col) of a checker's text reports (text): lines like ``ERROR(RSC-005): a.xhtml(3,7): why``."""
    found = reports.select(F.explode(F.split("text", r"\r?\n")).alias("l")).select(F.trim("l").alias("l")).where(F.col("l").rlike(CHECKER))
    rest = F.regexp_extract("l", CHECKER, 3)
    place, tail = F.split_part(rest, F.lit(":"), F.lit(1)), F.trim(F.substr(rest, F.locate(":", rest) + 1))
    parts = found.select(F.regexp_extract("l", CHECKER, 2).alias("id"), F.regexp_extract("l", CHECKER, 1).alias("severity"), F.when(rest.contains(":"), tail).otherwise(rest).alias("message"), F.when(rest.contains(":"), F.trim(place)).otherwise("").alias("place"))
    at = lambda i: F.regexp_extract("place", LOCATION, i)
    placed = F.col("place").rlike(LOCATION)
    return parts.select("id", "severity", "message", F.when(placed, at(1)).otherwise(F.col("place")).alias("path"), F.when(placed, at(2).cast("int")).otherwise(0).alias("line"), F.when(placed, at(3).cast("int")).otherwise(0).alias("col"))


def checker_messages(reports: DataFrame) -> DataFrame:
    """(id, severity, message, path, line, col) of a checker's JSON reports (value): a row for each place of a message."""
    shape = "struct<messages:array<struct<ID:string,severity:string,message:string,locations:array<struct<path:string,line:int,column:int>>>>>"
    m = reports.select(F.explode(F.from_json("value", shape)["messages"]).alias("m"))
    at = m.select("m", F.explode_outer("m.locations").alias("at"))
    return at.select(F.col("m.ID").alias("id"), F.upper("m.severity").alias("severity"), F.col("m.message").alias("message"), F.coalesce("at.path", F.lit("")).alias("path"), F.coalesce("at.line", F.lit(0)).alias("line"), F.coalesce("at.column", F.lit(0)).alias("col"))


def ordered(issues: DataFrame) -> DataFrame:
    """Issues in a report's order: the gravest first, then by rule, path and line."""
    return issues.orderBy(severity_rank(F.col("severity")), "id", "path", "line", "message")


def resolve(base: Column, href: Column) -> Column:
    """A reference as a path from the archive's root: without query and fragment, decoded, with .. and . folded."""
    clean = F.regexp_replace(href, "[?#].*$", "")
    clean = F.coalesce(F.try_url_decode(F.replace(clean, F.lit("+"), F.lit("%2B"))), clean)
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(clean.startswith("/"), F.substring(clean, 2, 1_000_000)).otherwise(F.concat(folder, clean)), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def references(docs: DataFrame) -> DataFrame:
    """(epub, name, attribute, href) of every src and href of documents (epub, name, text)."""
    all_ = lambda a: F.transform(F.regexp_extract_all("text", F.lit(rf"(?i)\s{a}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), lambda h: F.struct(F.lit(a).alias("attribute"), h.alias("href")))
    return docs.select("epub", "name", F.explode(F.concat(all_("src"), all_("href"))).alias("r")).select("epub", "name", "r.*").where("href <> ''")


def reference_issues(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Remote references, and local ones to entries that don't exist. entries: epub, name."""
    refs = references(docs)
    remote = refs.where(F.col("href").rlike(REMOTE)).select(F.lit("RSC-006").alias("id"), F.lit("ERROR").alias("severity"), F.concat(F.lit("remote reference: "), "href").alias("message"), F.col("name").alias("path"), F.lit(0).alias("line"))
    local = refs.where(~F.col("href").rlike(REMOTE) & ~((F.col("attribute") == "href") & F.col("href").rlike("^(mailto|tel):")) & ~F.col("href").startswith("#"))
    local = local.withColumn("target", resolve(F.col("name"), F.col("href")))
    missing = local.join(entries.select("epub", F.col("name").alias("target")), ["epub", "target"], "left_anti")
    return remote.unionAll(missing.select(F.lit("RSC-007"), F.lit("ERROR"), F.concat(F.lit("missing: "), "href"), F.col("name"), F.lit(0)))


def _document_issues(name: str, source: bytes) -> list[tuple[str, str, str, int]]:
    """Issues of one XHTML document."""
    from collections import Counter
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError as e:
        return [("RSC-005", "FATAL", f"not well-formed: {e.msg}", e.position[0])]
    if not name.endswith((".xhtml", ".html", ".htm")):
        return []
    out, ns = [], "{http://www.w3.org/1999/xhtml}"
    if root.tag != f"{ns}html":
        return [("RSC-005", "ERROR", "the root is no XHTML html element", 1)]
    head, body = root.find(f"{ns}head"), root.find(f"{ns}body")
    if head is None or not "".join((t := head.find(f"{ns}title")) is not None and t.itertext() or ()).strip():
        out.append(("RSC-005", "ERROR", "no head with a title", 0))
    if body is None:
        out.append(("RSC-005", "ERROR", "no body", 0))
    out += [("ACC-001", "ERROR", "img without alt", 0) for x in root.iter(f"{ns}img") if x.get("alt") is None]
    out += [("RSC-005", "ERROR", f"id occurs more than once: {k}", 0) for k, n in Counter(x.get("id") for x in root.iter() if x.get("id")).items() if n > 1]
    if b"epub:" in source and b"xmlns:epub" not in source:
        out.append(("RSC-005", "WARNING", "prefix epub isn't declared", 0))
    return out


def _package_issues(source: bytes) -> list[tuple[str, str, str, int]]:
    """Issues of one package document: metadata, manifest and spine among themselves."""
    import re
    from collections import Counter
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError as e:
        return [("RSC-005", "FATAL", f"not well-formed: {e.msg}", e.position[0])]
    opf, dc = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
    if root.tag != f"{opf}package":
        return [("OPF-001", "FATAL", "the root is no OPF package element", 1)]
    out = []
    if not (root.get("version") or "").startswith("3"):
        out.append(("OPF-001", "WARNING", f"version {root.get('version')}", 0))
    ids, named = list(root.iter(f"{dc}identifier")), root.get("unique-identifier")
    if not ids:
        out.append(("OPF-001", "ERROR", "no dc:identifier", 0))
    elif named and named not in [x.get("id") for x in ids]:
        out.append(("OPF-001", "ERROR", "no dc:identifier that the package names", 0))
    out += [("OPF-001", "ERROR", "empty dc:identifier", 0) for x in ids if not (x.text or "").strip()]
    for tag in ("title", "language"):
        if not any((x.text or "").strip() for x in root.iter(dc + tag)):
            out.append(("OPF-001", "ERROR", f"no dc:{tag}", 0))
    modified = [x.text or "" for x in root.iter(f"{opf}meta") if x.get("property") == "dcterms:modified"]
    if not modified:
        out.append(("OPF-001", "ERROR", "no dcterms:modified", 0))
    out += [("OPF-001", "ERROR", f"malformed dcterms:modified: {m}", 0) for m in modified if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", m.strip())]
    out += [("OPF-003", "ERROR", f"id occurs more than once in the document: {k}", 0) for k, n in Counter(x.get("id") for x in root.iter() if x.get("id")).items() if n > 1]
    out += [("OPF-001", "WARNING", f"old meta: {x.get('name')}", 0) for x in root.iter(f"{opf}meta") if x.get("name") not in (None, "cover")]
    items = list(root.iter(f"{opf}item"))
    out += [("OPF-003", "ERROR", "item lacks id or href", 0) for x in items if not x.get("id") or not x.get("href")]
    for key in ("id", "href"):
        out += [("OPF-003", "ERROR", f"{key} occurs more than once: {k}", 0) for k, n in Counter(x.get(key) for x in items if x.get(key)).items() if n > 1]
    out += [("RSC-006", "ERROR", f"remote manifest href: {x.get('href')}", 0) for x in items if re.match(REMOTE, x.get("href") or "")]
    if sum("nav" in (x.get("properties") or "").split() for x in items) != 1:
        out.append(("OPF-014", "ERROR", "not exactly one nav item", 0))
    spine, known = [x.get("idref") for x in root.iter(f"{opf}itemref")], {x.get("id") for x in items}
    if not spine:
        out.append(("OPF-012", "ERROR", "empty spine", 0))
    out += [("OPF-012", "ERROR", f"spine names an unknown item: {x}", 0) for x in spine if x not in known]
    out += [("OPF-012", "WARNING", f"not in the spine: {x.get('href')}", 0) for x in items if x.get("media-type") == "application/xhtml+xml" and x.get("id") not in spine and "nav" not in (x.get("properties") or "").split()]
    return out


def document_issues(entries: DataFrame) -> DataFrame:
    """Issues of the XML documents among the entries (epub, name, content)."""
    ship(entries.sparkSession)

    @F.pandas_udf("array<struct<id:string,severity:string,message:string,line:int>>")
    def check(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("id", "severity", "message", "line"), r, strict=True)) for r in (_package_issues(bytes(c)) if n.endswith(".opf") else _document_issues(n, bytes(c)))] for n, c in zip(names, contents, strict=True)], dtype="object")

    xml = entries.where(F.col("name").rlike(r"\.(opf|xhtml|html|htm|xml|ncx)$"))
    found = xml.select("name", F.explode(check("name", "content")).alias("i"))
    return found.select("i.id", "i.severity", "i.message", F.col("name").alias("path"), "i.line")


def lint(entries: DataFrame) -> DataFrame:
    """All issues of archives given as entries (epub, ord, name, stored, content)."""
    docs = entries.where(F.col("name").rlike(r"\.(xhtml|html|htm)$")).select("epub", "name", F.decode("content", "UTF-8").alias("text"))
    parts = [archive_issues(entries), rootfile_issues(entries), document_issues(entries), reference_issues(docs, entries), manifest_target_issues(entries, manifest_items(entries))]
    return reduce(DataFrame.unionByName, parts)


def merged(reports: DataFrame) -> DataFrame:
    """One row of reports (ran, files, error): any ran, files summed, errors joined in their order."""
    errors = F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: x["error"])
    return reports.agg(F.bool_or("ran").alias("ran"), F.sum("files").alias("files"), F.array_join(F.filter(errors, lambda e: e != ""), " | ").alias("error"))


def report_lines(issues: DataFrame, n: int = 20) -> DataFrame:
    """(severity, ord, line): a text report: for each severity a heading with its count, its first n issues, and how many
    more there are. The limit is the report's feature."""
    rows = issues.withColumn("shown", F.concat(F.lit("- ["), "id", F.lit("] "), "message", F.lit(" ("), "path", F.when(F.col("line") > 0, F.concat(F.lit(":"), "line")).otherwise(""), F.lit(")")))
    top = top_per_group(rows, "severity", ["id", "path", "line", "message"], n)
    heads = issues.groupBy("severity").agg(F.count("*").alias("c")).select("severity", F.lit(0).alias("ord"), F.concat(F.lit("## "), "severity", F.lit(": "), "c").alias("line"))
    more = top.where("more > 0").select("severity", "more").distinct().select("severity", F.lit(n + 1).alias("ord"), F.concat(F.lit("- and "), "more", F.lit(" more")).alias("line"))
    return heads.unionByName(top.select("severity", F.col("nth").alias("ord"), F.col("shown").alias("line"))).unionByName(more)
