"""Files into rows of text: one job over binary files, one branch for each format."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions import rules, text
from larkdoc.operators.chunking import chunk_documents
from larkdoc.operators.common import written

ROWS = "path string, extension string, page int, slide int, sheet string, text string, error string"


def fingerprint(content: Column) -> list[Column]:
    """(file_hash, size) of a file's bytes."""
    return [F.sha2(content, 256).alias("file_hash"), F.length(content).cast("long").alias("size")]


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = rules.EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files under ``path``: path, extension, content, file_hash, size; and path, reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    good = F.col("extension").isin(*extensions)
    accepted = files.where(good).select("path", "extension", "content", *fingerprint(F.col("content")))
    return accepted, files.where(~good).select("path", F.concat(F.lit("unsupported: "), "extension").alias("reason"))


def decoded(content: Column) -> Column:
    """UTF-8 text, Latin-1 if it isn't valid as such; line ends are newlines."""
    whole = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(whole, "\r\n?", "\n")


#: The bytes that Windows-1252 reads otherwise than Latin-1, and their characters; ``decode`` has only the latter.
_WINDOWS = {chr(b): bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}


def scraped(content: Column) -> Column:
    """Readable segments of a legacy binary document in Windows-1252, cut at carriage returns.

    A segment has four characters or more, over six tenths of them letters, digits, white space or common
    marks. Runs of control characters are one space; bytes without a character count as unreadable.
    """
    whole = F.translate(F.decode(content, "ISO-8859-1"), "".join(_WINDOWS), "".join(_WINDOWS.values()))
    plain = F.regexp_replace(F.regexp_replace(whole, r"\x00+", " "), r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]+", " ")
    readable = lambda s: F.length(F.regexp_replace(s, r"(?U)[^\p{L}\p{N}\s.,;:!?()\-]", ""))
    kept = F.filter(F.transform(F.split(plain, "\r"), text.strip), lambda s: (F.length(s) >= 4) & (readable(s) > 0.6 * F.length(s)))
    return F.array_join(kept, "\n")


class _Html(HTMLParser):
    """Text outside dropped elements."""

    DROPPED = frozenset(("script", "style", "nav", "footer", "header", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.part = 0, [], []

    def _end_part(self) -> None:
        if said := "".join(self.part).strip():
            self.found.append(said)
        self.part = []

    def handle_starttag(self, tag, attrs):
        self._end_part()
        self.depth += tag in self.DROPPED

    def handle_endtag(self, tag):
        self._end_part()
        self.depth -= tag in self.DROPPED and self.depth > 0

    def handle_startendtag(self, tag, attrs):
        self._end_part()

    def handle_comment(self, data):
        self._end_part()

    def handle_data(self, data):
        if not self.depth:
            self.part.append(data)


def html_text(markup: str) -> str:
    parser = _Html()
    parser.feed(markup)
    parser.close()
    parser._end_part()
    return "\n".join(parser.found)


def csv_text(content: str) -> str:
    rows = ([cell.strip() for cell in row] for row in csv.reader(io.StringIO(content)))
    return "\n".join(", ".join(row) for row in rows if any(row))


def json_text(content: str) -> str:
    """``path: value`` lines in the order of the file."""

    def lines(value: object, path: str) -> Iterator[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from lines(v, f"{path}.{k}" if path else str(k))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from lines(v, f"{path}[{i}]")
        else:
            yield f"{path}: {value}" if path else str(value)

    return "\n".join(line for line in lines(json.loads(content), "") if line.strip())


def xml_text(content: str) -> str:
    """``name: text`` of each element that has text, depth first; what stands behind it follows its children."""

    def lines(element: ElementTree.Element) -> Iterator[str]:
        if element.text and element.text.strip():
            yield f"{element.tag.rpartition('}')[2]}: {element.text.strip()}"
        for child in element:
            yield from lines(child)
        if element.tail and element.tail.strip():
            yield element.tail.strip()

    return "\n".join(lines(ElementTree.fromstring(content)))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _parts(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) == name)


def _words(element: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in _parts(element, "t")).strip()


def _table_rows(root: ElementTree.Element) -> Iterator[str]:
    for row in _parts(root, "tr"):
        if cells := [c for c in (_words(cell) for cell in _parts(row, "tc")) if c]:
            yield " | ".join(cells)


def docx_rows(content: bytes) -> Iterator[dict]:
    """One row: paragraphs outside tables, then table rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    inside = {p for table in _parts(body, "tbl") for p in _parts(table, "p")}
    lines = [said for p in _parts(body, "p") if p not in inside and (said := _words(p))] + list(_table_rows(body))
    yield {"text": "\n".join(lines)}


def pptx_rows(content: bytes) -> Iterator[dict]:
    """One row for each slide with text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in names:
            slide, lines = ElementTree.fromstring(archive.read(name)), []
            for shape in (e for e in slide.iter() if _local(e) in ("sp", "graphicFrame")):
                lines += list(_table_rows(shape)) if _local(shape) == "graphicFrame" else [said for p in _parts(shape, "p") if (said := _words(p))]
            if lines:
                yield {"slide": number, "text": "\n".join(lines)}


def xlsx_rows(content: bytes) -> Iterator[dict]:
    """One row for each sheet with cells; stored values, not formulas."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = [_words(e) for e in _parts(ElementTree.fromstring(archive.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _parts(book, "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root, rows = ElementTree.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")), []
            for row in _parts(root, "row"):
                cells = []
                for cell in _parts(row, "c"):
                    value = next(_parts(cell, "v"), None)
                    said = _words(cell) if cell.get("t") == "inlineStr" else "" if value is None else value.text or ""
                    said = shared[int(said)] if cell.get("t") == "s" and said else said
                    if said.strip():
                        cells.append(said.strip())
                if cells:
                    rows.append(" | ".join(cells))
            if rows:
                yield {"sheet": sheet.get("name"), "text": "\n".join(rows)}


def _of_text(extract: Callable[[str], str]) -> Callable[[bytes], Iterator[dict]]:
    return lambda content: iter([{"text": extract(content.decode("utf-8"))}])


#: How rows come from a file's bytes, by extension; add to a copy of it for other formats (a PDF reader gives a row for each page).
EXTRACTORS: dict[str, Callable[[bytes], Iterator[dict]]] = {
    ".csv": _of_text(csv_text),
    ".json": _of_text(json_text),
    ".xml": _of_text(xml_text),
    ".html": lambda content: iter([{"text": html_text(content.decode("utf-8", "replace"))}]),
    ".docx": docx_rows,
    ".pptx": pptx_rows,
    ".xlsx": xlsx_rows,
}


def extract_rows(files: DataFrame, extractors: dict[str, Callable[[bytes], Iterator[dict]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of (path, extension, content): rows with text, and (path, reason) for files that can't be read.

    Plain text and legacy documents stay inside the JVM. Blank rows are dropped. What is extracted is
    written once, as rows, rejects and all that follows read it.
    """
    extractors = EXTRACTORS if extractors is None else extractors

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ROWS.split(", ")]
        for frame in batches:
            found = []
            for path, extension, content in zip(frame["path"], frame["extension"], frame["content"], strict=True):
                try:
                    found += [{"path": path, "extension": extension} | row for row in extractors[extension](bytes(content))]
                except Exception as problem:  # any file can be broken in any way; it becomes a reject with its reason
                    found.append({"path": path, "extension": extension, "error": f"{type(problem).__name__}: {problem}"[:200]})
            frame = pd.DataFrame(found, columns=names, dtype=object)
            yield frame.where(frame.notna(), None)

    read = files.where(F.col("extension").isin(*extractors)).select("path", "extension", "content").mapInPandas(task, ROWS)
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("page", "int"), ("slide", "int"), ("sheet", "string"))]
    plain = files.where(F.col("extension").isin(".txt", ".md", ".doc")).select("path", "extension", *empty, F.when(F.col("extension") == ".doc", scraped(F.col("content"))).otherwise(decoded(F.col("content"))).alias("text"), F.lit(None).cast("string").alias("error"))
    rows = written(plain.unionByName(read), "extracted")
    return rows.where("error is null").where(~text.is_blank(F.col("text"))).drop("error"), rows.where("error is not null").select("path", F.col("error").alias("reason"))


def extractor_function(extractors: dict[str, Callable[[bytes], Iterator[dict]]] | None = None) -> type:
    """A table function (extension, content) to rows (page, slide, sheet, text, error), one for each row of the file or one that says why it can't be read."""
    extractors = EXTRACTORS if extractors is None else extractors

    class ExtractFile:
        def eval(self, extension: str, content: bytes) -> Iterator[tuple]:
            try:
                rows = [(r.get("page"), r.get("slide"), r.get("sheet"), r["text"], None) for r in extractors[extension](bytes(content))]
            except Exception as problem:  # any file can be broken in any way; it becomes a row with its reason
                rows = [(None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
            yield from rows

    return F.udtf(ExtractFile, returnType="page int, slide int, sheet string, text string, error string")


def register_extractor(spark: SparkSession, name: str = "extract_file", extractors: dict[str, Callable[[bytes], Iterator[dict]]] | None = None) -> None:
    """For SQL: ``SELECT f.path, x.* FROM files f, LATERAL extract_file(f.extension, f.content) x``."""
    spark.udtf.register(name, extractor_function(extractors))


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else html_text(p))


@F.pandas_udf(T.StringType())
def flatten_json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json_text(v))


def flatten_object(value: Column) -> Column:
    """``key: value`` lines of a one-level JSON object, keys in order; inside the JVM."""
    held = F.from_json(value, "map<string,string>")
    lines = F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    return F.array_join(lines, "\n")


DOCUMENT_KEY = ("path", "page", "slide", "sheet")


def ingest(files: DataFrame, stamp: dict[str, str], embed: Callable[[Column], Column], extractors: dict[str, Callable[[bytes], Iterator[dict]]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, jobs, result) of ``files`` (path, extension, content): extract, stamp, cut, number, embed.

    ``documents`` has a row for each file that gave text: path, name, file_hash, file_size and the stamp.
    Chunks are keyed by path, page, slide and sheet, carry the stamp and an embedding, and are numbered
    (chunk_index) over their file. ``jobs`` says completed or failed, with the reason, for each file;
    ``result`` is one row (files_processed, chunks_indexed). Texts are extracted, cut and embedded once.
    """
    rows, rejects = extract_rows(files, extractors)
    stamps = {name: F.lit(value) for name, value in stamp.items()}
    cut = chunk_documents(rows, keys=DOCUMENT_KEY)
    place = Window.partitionBy("path").orderBy(F.col("page").asc_nulls_first(), F.col("slide").asc_nulls_first(), F.col("sheet").asc_nulls_first(), "chunk_no")
    numbered = cut.withColumns({"chunk_index": F.row_number().over(place) - 1, "chunk_chars": F.length("text"), "extension": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))})
    chunks = written(numbered.withColumn("embedding", embed(F.col("text"))).withColumns(stamps), "chunks")
    named = files.select("path", text.display_name(F.col("path")).alias("name"), *fingerprint(F.col("content"))).withColumnRenamed("size", "file_size")
    documents = named.join(rows.select("path").distinct(), "path", "left_semi").withColumns(stamps)
    jobs = files.select("path").join(rejects.groupBy("path").agg(F.min("reason").alias("reason")), "path", "left").select("path", F.when(F.col("reason").isNull(), "completed").otherwise("failed").alias("status"), "reason")
    result = files.agg(F.count("*").alias("files_processed")).crossJoin(chunks.agg(F.count("*").alias("chunks_indexed")))  # rows of one
    return documents, chunks, jobs, result
