"""Books as documents: PDF and EPUB files, read as binary and parsed in Arrow batches.

EPUB needs nothing but the standard library; PDF needs a parser, which is passed in as a function (bytes -> list of page texts), since none
comes with Python. Files that can't be read give a null text and their error, never a failed job."""

import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, slug, stripped

SUFFIXES = (".pdf", ".epub")


def book_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the folder's own PDF and EPUB files, suffix in any case."""
    return spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(pdf|epub)$")).select("path", "content")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and (s := data.strip()):
            self.out.append(s)


def html_text(page: str) -> str:
    """The strings of a page outside scripts and styles, a line each."""
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(p.out)


def spine(book: zipfile.ZipFile) -> list[str]:
    """Members of an EPUB in reading order; all HTML members by name if the package doesn't say."""
    found: list[str] = []
    try:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        base = posixpath.dirname(opf)
        items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
        for ref in (e for e in package.iter() if e.tag.endswith("itemref")):
            item = items.get(ref.attrib.get("idref", ""), {})
            if "html" in item.get("media-type", ""):
                found.append(posixpath.normpath(posixpath.join(base, unquote(item["href"]))))
    except (KeyError, StopIteration, ElementTree.ParseError):
        pass
    return found or sorted(n for n in book.namelist() if re.search(r"\.x?html?$", n, re.I))


def epub_text(content: bytes) -> str:
    """Texts of the spine's members with an empty line between; members that can't be read are skipped."""
    parts = []
    with zipfile.ZipFile(BytesIO(content)) as book:
        for name in spine(book):
            try:
                text = html_text(book.read(name).decode("utf-8", "replace"))
            except (KeyError, zipfile.BadZipFile):
                continue
            if text:
                parts.append(text)
    return "\n\n".join(parts)


def book_documents(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(document_id, title, source_path, format, text, error) from (path, content): normalised text, title from its first line, else the file's name; ids from the 1-based place by path and a slug."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if path.lower().endswith(".epub"):
                        text = epub_text(content)
                    elif pdf_pages is None:
                        raise ValueError("no PDF parser was given")
                    else:
                        text = "\n\n".join(p for p in map(str.strip, pdf_pages(content)) if p)
                    texts.append(text)
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    raw = files.select("path", "content").mapInArrow(run, "path string, text string, error string")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    d = raw.select("path", normalized(F.col("text")).alias("text"), "error", stem.alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("format"))
    first = F.try_element_at(F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != ""), F.lit(1))
    # only paths are numbered in one place, the texts stay where they are
    numbers = files.select("path").distinct().withColumn("n", F.row_number().over(Window.orderBy("path")))
    d = d.join(numbers, "path")
    return d.select(F.concat(F.format_string("doc_%02d_", "n"), F.left(slug(F.col("stem")), F.lit(48))).alias("document_id"), F.coalesce(first, "stem").alias("title"), F.col("path").alias("source_path"), "format", "text", "error")
