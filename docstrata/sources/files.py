"""Sources and sinks: Markdown, Word and request files as relations (survey ids SC1, SC5, SC14 to SC16)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"  # fixed value: the format's namespace
REQUEST = "protocol_version string, run_id string, request_id string, phase string, capability string, prompt string, input_hash string"
RESPONSE = "protocol_version string, request_id string, raw_response string, input_hash string"
RECORDS = (
    "doc_id string, pos int, kind string, style string, t string, items string, is_centered boolean, mostly_bold boolean, max_size double, has_page_boundary boolean, "
    "has_toc_field boolean, has_pageref boolean, num_id int, ilvl int, style_num_id int, left_twips int"
)
DEFINITIONS = "doc_id string, num_id int, ilvl int, num_fmt string, lvl_text string, p_style string, start int"
OBJECTS = "doc_id string, media_files int, drawings int, relationships int"


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of Markdown files, a file a document, lines from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, line) of Markdown files, the input of the plans; the path is the doc_id."""
    return markdown_lines(spark, path).withColumnRenamed("path", "doc_id")


def _parsed(spark: SparkSession, path: str, schema: str, parse: Callable[[str, zipfile.ZipFile], list[tuple]]) -> DataFrame:
    """The rows that parse makes of each Word file. A file that is none gives no row; unread_files names it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = parse(name, zipfile.ZipFile(io.BytesIO(content)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, schema)


def _root(held: zipfile.ZipFile, part: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(held.read(part)) if part in held.namelist() else None


def _value(node: ElementTree.Element | None, *steps: str) -> str | None:
    for step in steps:
        node = None if node is None else node.find(f"{WORD}{step}")
    return None if node is None else node.get(f"{WORD}val")


def _int(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch("-?[0-9]+", value) else None


def _is_on(node: ElementTree.Element | None) -> bool:
    return node is not None and node.get(f"{WORD}val", "1") not in ("0", "false", "off", "none")


def _text(paragraph: ElementTree.Element) -> str:
    """Text of a paragraph's runs, tabs and breaks in their place."""
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{WORD}t" else marks.get(x.tag, "") for run in paragraph.iter(f"{WORD}r") for x in run)


def _record(name: str, pos: int, node: ElementTree.Element, styles: dict[str, tuple[str, int | None]]) -> tuple:
    if node.tag == f"{WORD}tbl":
        # Of cells that are merged downwards only the first counts.
        cells = [c for c in node.iter(f"{WORD}tc") if (m := c.find(f"{WORD}tcPr/{WORD}vMerge")) is None or m.get(f"{WORD}val") == "restart"]
        items = [t for cell in cells for x in cell.findall(f"{WORD}p") if (t := _text(x).strip())]
        return name, pos, "table", "", " ".join(items), "|".join(x.replace("|", "/") for x in items), False, False, None, False, False, False, None, None, None, None
    own = node.find(f"{WORD}pPr")
    style, style_num = styles.get(_value(own, "pStyle") or "", (_value(own, "pStyle") or "", None))
    runs = list(node.iter(f"{WORD}r"))
    bold = sum(_is_on(r.find(f"{WORD}rPr/{WORD}b")) for r in runs)
    sizes = [size for r in runs if (size := _int(_value(r, "rPr", "sz"))) is not None]
    said = " ".join([x.text or "" for x in node.iter(f"{WORD}instrText")] + [x.get(f"{WORD}instr", "") for x in node.iter(f"{WORD}fldSimple")])
    border = any(x.get(f"{WORD}type") == "page" for x in node.iter(f"{WORD}br")) or any(True for tag in ("lastRenderedPageBreak", "sectPr") for _ in node.iter(f"{WORD}{tag}"))
    linked = bool(re.search(r"(?i)\bPAGEREF\b", said)) or next(node.iter(f"{WORD}hyperlink"), None) is not None
    indent = None if own is None or own.find(f"{WORD}ind") is None else own.find(f"{WORD}ind").get(f"{WORD}left")
    number = _int(_value(own, "numPr", "numId"))
    return (
        name, pos, "paragraph", style, _text(node), None, _value(own, "jc") == "center", bold > len(runs) / 2, max(sizes) / 2 if sizes else None, border,
        bool(re.search(r"(?i)\bTOC\b", said)), linked, number, None if number is None else _int(_value(own, "numPr", "ilvl")) or 0, style_num, _int(indent),
    )


def docx_records(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs and tables of Word files in order, as records of the plans (SC5, SC6, SC7, F31, F32).

    A table is one record, its cells' paragraphs in items, a bar between them.
    """

    def parse(name: str, held: zipfile.ZipFile) -> list[tuple]:
        sheet = _root(held, "word/styles.xml")
        listed = [] if sheet is None else sheet.iter(f"{WORD}style")
        styles = {x.get(f"{WORD}styleId"): (_value(x, "name") or "", _int(_value(x, "pPr", "numPr", "numId"))) for x in listed}
        body = ElementTree.fromstring(held.read("word/document.xml")).find(f"{WORD}body")
        kept = [x for x in body if x.tag in (f"{WORD}p", f"{WORD}tbl")]
        return [_record(name, pos, x, styles) for pos, x in enumerate(kept)]

    return _parsed(spark, path, RECORDS, parse)


def docx_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Levels of the numbering definitions of Word files, overrides applied (SC8)."""

    def parse(name: str, held: zipfile.ZipFile) -> list[tuple]:
        root = _root(held, "word/numbering.xml")
        if root is None:
            return []
        level = lambda x: {"num_fmt": _value(x, "numFmt"), "lvl_text": _value(x, "lvlText"), "p_style": _value(x, "pStyle") or "", "start": _int(_value(x, "start"))}
        place = lambda x: _int(x.get(f"{WORD}ilvl")) or 0
        shared = {x.get(f"{WORD}abstractNumId"): {place(y): level(y) for y in x.findall(f"{WORD}lvl")} for x in root.findall(f"{WORD}abstractNum")}
        rows = []
        for num in root.findall(f"{WORD}num"):
            levels = {k: dict(v) for k, v in shared.get(_value(num, "abstractNumId"), {}).items()}
            for change in num.findall(f"{WORD}lvlOverride"):
                own = levels.setdefault(place(change), {})
                if change.find(f"{WORD}lvl") is not None:
                    own |= {k: v for k, v in level(change.find(f"{WORD}lvl")).items() if v}
                if (start := _int(_value(change, "startOverride"))) is not None:
                    own["start"] = start
            number = _int(num.get(f"{WORD}numId"))
            rows += [(name, number, k, v.get("num_fmt"), v.get("lvl_text"), v.get("p_style", ""), v.get("start") if v.get("start") is not None else 1) for k, v in sorted(levels.items())]
        return rows

    return _parsed(spark, path, DEFINITIONS, parse)


def non_text_objects(spark: SparkSession, path: str) -> DataFrame:
    """Media files, drawings and relationships of Word files (SC10)."""

    def parse(name: str, held: zipfile.ZipFile) -> list[tuple]:
        media = [x for x in held.namelist() if x.startswith("word/media/") and not x.endswith("/")]
        document, links = _root(held, "word/document.xml"), _root(held, "word/_rels/document.xml.rels")
        drawings = 0 if document is None else sum(1 for _ in document.iter(f"{WORD}drawing"))
        return [(name, len(media), drawings, 0 if links is None else len(list(links)))]

    return _parsed(spark, path, OBJECTS, parse)


def media_preservation(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc_id, ratio): media files of the output for each of the source, 1 without any (A12). Both as non_text_objects gives them."""
    kept = output.select("doc_id", F.col("media_files").alias("kept"))
    ratio = F.coalesce(F.try_divide(F.coalesce("kept", F.lit(0)).cast("double"), F.col("media_files").cast("double")), F.lit(1.0))
    return source.join(kept, "doc_id", "left").select("doc_id", ratio.alias("ratio"))


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that are no Word documents."""
    read = _parsed(spark, path, OBJECTS, lambda name, held: [(name, 0, 0, 0)] if "word/document.xml" in held.namelist() else [])
    return spark.read.format("binaryFile").load(path).select("path").join(read, F.col("path") == F.col("doc_id"), "left_anti")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path).where("request_id IS NOT NULL")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path).where("request_id IS NOT NULL")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.write.mode("overwrite").json(path)
