"""E-book packages: manifest, spine, package document, and the archive."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shipping import ship

# Media types by suffix.
MEDIA_TYPES = {
    "xhtml": "application/xhtml+xml",
    "html": "application/xhtml+xml",
    "htm": "application/xhtml+xml",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "jp2": "image/jp2",
    "css": "text/css",
    "js": "text/javascript",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "woff": "font/woff",
    "woff2": "font/woff2",
}


def media_type(href: Column) -> Column:
    """The media type of a file by its suffix, null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(href, r"\.([^./]+)$", 1)))


def has_mathml(text: Column) -> Column:
    return text.contains("http://www.w3.org/1998/Math/MathML") | text.rlike(r"<math[\s>]")


def manifest(files: DataFrame) -> DataFrame:
    """(book_id, href, media_type, item_id, properties) of files (book_id, href, text) with a known type; ids are unique in a book."""
    m = files.withColumn("media_type", media_type(F.col("href"))).where("media_type is not null")
    base = F.regexp_replace(F.regexp_extract("href", r"([^/]*?)(?:\.[^./]*)?$", 1), r"[^\p{L}\p{N}_-]+", "-")
    order = Window.partitionBy("book_id", "base").orderBy("href")
    m = m.withColumn("base", F.concat(F.lit("i-"), base)).withColumn("nth", F.row_number().over(order))
    # base, base-2, base-3 ...; where a file of the book has such a name by itself, a sign that no name has.
    named = m.select("book_id", F.col("base").alias("numbered")).distinct().withColumn("used", F.lit(True))
    m = m.withColumn("numbered", F.concat("base", F.lit("-"), "nth")).join(named, ["book_id", "numbered"], "left")
    item = F.when(F.col("nth") == 1, F.col("base")).when(F.col("used"), F.concat("base", F.lit("~"), "nth")).otherwise(F.col("numbered"))
    return m.select("book_id", "href", "media_type", item.alias("item_id"), F.when((F.col("media_type") == "application/xhtml+xml") & has_mathml(F.coalesce("text", F.lit(""))), "mathml").otherwise("").alias("properties"))


def spine_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, pos, href): the spine's XHTML documents in its order, then those it leaves out, by name.

    spine: book_id, ord, href; manifest: book_id, href, media_type. Spine entries that aren't in the manifest are dropped.
    """
    docs = manifest.where("media_type = 'application/xhtml+xml'").select("book_id", "href")
    first = spine.groupBy("book_id", "href").agg(F.min("ord").alias("ord"))
    named = docs.join(first, ["book_id", "href"], "left")
    order = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("ord"), "href")
    return named.select("book_id", F.row_number().over(order).alias("pos"), "href")


def spine_warnings(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, href, warning): spine entries that are missing or no XHTML, and documents that the spine leaves out."""
    j = spine.join(manifest.select("book_id", "href", "media_type"), ["book_id", "href"], "left")
    bad = j.select("book_id", "href", F.when(F.col("media_type").isNull(), "missing").when(F.col("media_type") != "application/xhtml+xml", "not XHTML").alias("warning")).where("warning is not null")
    out = manifest.where("media_type = 'application/xhtml+xml'").join(spine, ["book_id", "href"], "left_anti")
    return bad.unionAll(out.select("book_id", "href", F.lit("not in the spine")))


def image_choice(images: DataFrame) -> DataFrame:
    """Images (name, digest, ord) with the file name each is stored under: one file for each content; of several contents with
    a name, the second and later ones get a number."""
    first = images.groupBy("name", "digest").agg(F.min("ord").alias("ord"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)?$", 1)
    named = first.withColumn("nth", nth).withColumn("stored_as", F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("nth"), suffix)))
    return images.join(named.select("name", "digest", "stored_as"), ["name", "digest"])


def identifier(raw: str | None, seed: str) -> str:
    """A sound identifier as it is; an empty one or a malformed urn:uuid gets one that seed decides."""
    text = (raw or "").strip()
    if text.startswith("urn:uuid:"):
        try:
            return f"urn:uuid:{uuid.UUID(text[9:])}"
        except ValueError:
            text = ""
    return text or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}"


def container_document(path: str) -> str:
    """META-INF/container.xml, which names the package document."""
    return f'<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{path}" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


def package_document(book: dict, items: list[dict], spine: list[str], modified: str) -> str:
    """The OPF of a book; items have item_id, href, media_type, properties, and spine has hrefs."""
    ids = {i["href"]: i["item_id"] for i in items}
    meta = [f'<dc:identifier id="uid">{escape(identifier(book.get("identifier"), book.get("title") or ""))}</dc:identifier>', f"<dc:title>{escape(book.get('title') or 'Untitled')}</dc:title>", f"<dc:language>{escape(book.get('language') or 'zh')}</dc:language>", f'<meta property="dcterms:modified">{modified}</meta>']
    meta += [f"<dc:{t}>{escape(book[k])}</dc:{t}>" for t, k in (("creator", "author"), ("publisher", "publisher"), ("description", "description")) if book.get(k)]
    rows = [f'<item id={quoteattr(i["item_id"])} href={quoteattr(i["href"])} media-type={quoteattr(i["media_type"])}' + (f' properties={quoteattr(i["properties"])}' if i["properties"] else "") + "/>" for i in items]
    refs = [f"<itemref idref={quoteattr(ids[h])}/>" for h in spine if h in ids]
    body = "\n".join(["<metadata xmlns:dc=\"http://purl.org/dc/elements/1.1/\">", *meta, "</metadata>", "<manifest>", *rows, "</manifest>", "<spine>", *refs, "</spine>"])
    return f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">\n{body}\n</package>\n'


def navigation(toc: list[dict], title: str) -> str:
    """The nav document of entries (title, href, level); levels may jump, since an entry hangs below the nearest smaller one."""
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc">'
    out, open_ = [head], []
    for e in toc:
        closed = 0
        while open_ and open_[-1] >= e["level"]:
            open_.pop()
            out.append("</ol></li>" if closed else "</li>")
            closed += 1
        if not closed:
            out.append("<ol>")
        open_.append(e["level"])
        out.append(f'<li><a href={quoteattr(e["href"])}>{escape(e["title"])}</a>')
    out += ["</li></ol>"] * len(open_)
    return "".join(out) + "</nav></body></html>\n"


def archive(files: dict[str, bytes]) -> bytes:
    """A package's zip: mimetype first and stored, the rest by name and deflated, all with one fixed time: equal input, equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ["mimetype", *sorted(n for n in files if n != "mimetype")]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, b"application/epub+zip" if name == "mimetype" else files[name])
    return out.getvalue()


def archives(files: DataFrame) -> DataFrame:
    """(book_id, epub binary) of files (book_id, name, content): a book is one task, as it is one archive."""
    ship(files.sparkSession)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book_id": [group["book_id"].iloc[0]], "epub": [archive({n: bytes(c) for n, c in zip(group["name"], group["content"], strict=True)})]})

    return files.select("book_id", "name", "content").groupBy("book_id").applyInPandas(pack, "book_id string, epub binary")


def modified_stamp(files: DataFrame) -> DataFrame:
    """(book_id, modified): the latest time of files (book_id, mtime, generated) that weren't generated, as UTC text."""
    latest = F.max(F.when(~F.col("generated"), F.col("mtime")))
    return files.groupBy("book_id").agg(F.date_format(latest, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


def fixed_images(html: Column) -> Column:
    """Image tags as packages take them: the folder above, and widths in percent as style."""
    return F.regexp_replace(F.replace(html, F.lit('src="images/'), F.lit('src="../images/')), r'\swidth="(\d+(?:\.\d+)?)%"', ' style="width:$1%"')


def book_records(files: DataFrame) -> DataFrame:
    """(file, title, author, language, publisher, description, identifier, cover, spine, toc) of book.json files (file, value):
    texts stripped, numbers as texts, Chinese where no language is given, paths without ./ at the start. What is no object is
    left out, as it can't be a book."""
    names = ("title", "author", "language", "publisher", "description", "identifier", "cover")
    shape = "struct<" + ", ".join(f"{n}: string" for n in names) + ", spine: array<string>, toc: array<struct<title: string, href: string, level: int>>>"
    b = files.where(F.trim("value").startswith("{")).withColumn("b", F.from_json("value", shape)).where("b is not null")
    text = lambda n: F.coalesce(F.trim(F.col(f"b.{n}")), F.lit(""))
    path = lambda c: F.regexp_replace(c, r"^[./]+", "")
    made = {n: text(n) for n in names} | {"language": F.coalesce(F.nullif(text("language"), F.lit("")), F.lit("zh")), "cover": path(text("cover"))}
    spine = F.filter(F.transform(F.coalesce("b.spine", F.array().cast("array<string>")), lambda x: path(F.replace(x, F.lit("\\"), F.lit("/")))), lambda x: F.trim(x) != "")
    return b.select("file", *[c.alias(n) for n, c in made.items()], spine.alias("spine"), "b.toc")


def repeated_targets(items: DataFrame) -> DataFrame:
    """Items (book_id, ord, href) whose target an earlier one of the book has, and the number of that one."""
    by = Window.partitionBy("book_id", "href").orderBy("ord")
    seen = items.withColumn("first", F.first("ord").over(by)).withColumn("nth", F.row_number().over(by))
    return seen.where("nth > 1").select("book_id", "ord", "href", "first")


def last_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one, by order; ties are all kept. Only keys and orders are shuffled for the choice."""
    last = rows.groupBy(key).agg(F.max(order).alias("__last")).withColumnRenamed(key, "__key")
    return rows.join(last, F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__last"))).select(*rows.columns)
