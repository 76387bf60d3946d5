"""Text out of source documents, whatever their format. The only place that needs Python workers."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from email.headerregistry import HeaderRegistry
from email.parser import BytesParser
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions.text import trim_text
from gradeflow.sources.paths import below

# Formats, and how much of a workbook is read.
PLAIN_SUFFIXES = ("txt", "md", "json", "csv")
PACKED_SUFFIXES = ("eml", "docx", "xlsx")
SHEETS, SHEET_ROWS, SHEET_COLUMNS = 4, 40, 12
# A file is one binary cell; Spark's largest is 2 GiB, and larger files are named, not read.
MAX_FILE_BYTES = 2_000_000_000

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def extract_documents(files: DataFrame, limit: int) -> DataFrame:
    """``path, content`` and any other columns to the same columns with ``text`` for ``content``."""
    suffix = suffix_of(F.col("path"))
    plain = files.where(suffix.isin(*PLAIN_SUFFIXES))
    packed = files.where(suffix.isin(*PACKED_SUFFIXES))
    other = files.where(~suffix.isin(*PLAIN_SUFFIXES, *PACKED_SUFFIXES))
    return _plain_text(plain, limit).unionByName(_packed_text(packed, limit)).unionByName(
        _noted(other, "(document available but not extracted: ", ")")
    )


def _kept(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c not in ("content", "length")]


def _plain_text(files: DataFrame, limit: int) -> DataFrame:
    """Plain formats, decoded by Spark itself."""
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(*_kept(files), trim_text(decoded, limit).alias("text"))


def _packed_text(files: DataFrame, limit: int) -> DataFrame:
    """Mail and office formats, read by Python workers in Arrow batches. A bad file gives a row saying so."""
    keep = _kept(files)
    fields = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep]
    read = files.select(*keep, "content").mapInPandas(_read_batches, ", ".join([*fields, "raw string", "failed boolean"]))
    text = F.when(F.col("failed"), F.col("raw")).otherwise(trim_text(F.col("raw"), limit))
    return read.select(*keep, text.alias("text"))


def _noted(files: DataFrame, opening: str, closing: str) -> DataFrame:
    note = F.concat(F.lit(opening), F.element_at(F.split("path", "/"), -1), F.lit(closing))
    return files.select(*_kept(files), note.alias("text"))


def read_document_files(spark: SparkSession, root: str, limit: int, tasks: DataFrame | None = None) -> DataFrame:
    """Every file under ``<root>/tasks/<task>/documents/`` as ``task_id, path, text``.

    Each kind of file is listed by its own name pattern, so a file's content is read once. With
    ``tasks`` only the documents of those ``task_id`` are extracted.
    """
    suffix = suffix_of(F.col("path"))
    known = suffix.isin(*PLAIN_SUFFIXES, *PACKED_SUFFIXES)
    fits = F.col("length") <= MAX_FILE_BYTES

    def files(pattern: str, condition: Column) -> DataFrame:
        found = list_document_files(spark, root, pattern).where(condition)
        return found if tasks is None else found.join(tasks.select("task_id"), "task_id", "left_semi")

    return (
        _plain_text(files(_glob(PLAIN_SUFFIXES), fits), limit)
        .unionByName(_packed_text(files(_glob(PACKED_SUFFIXES), fits), limit))
        .unionByName(_noted(files("*", known & ~fits), "(error reading ", ": file too large)"))
        .unionByName(_noted(files("*", ~known), "(document available but not extracted: ", ")"))
    )


def _glob(suffixes: tuple[str, ...]) -> str:
    """A file-name pattern for the suffixes in either case."""
    either = ["".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in suffixes]
    return "*.{" + ",".join(either) + "}"


def list_document_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``task_id, path, length, content``; Spark reads the content only where it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    place = below(root, r"/tasks/(.+?)/documents/(.+)$")
    return (
        reader.load(f"{root.rstrip('/')}/tasks")
        .select(
            F.regexp_extract("path", place, 1).alias("task_id"),
            F.regexp_extract("path", place, 2).alias("path"),
            "length",
            "content",
        )
        .where(F.col("path") != "")
    )


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    readers = {"eml": _mail_reader(), "docx": _word_text, "xlsx": _sheet_text}
    for batch in batches:
        pairs = zip(batch["path"], batch["content"], strict=True)
        results = [_read_one(readers, path, content) for path, content in pairs]
        out = batch.drop(columns="content")
        out["raw"] = [text for text, _ in results]
        out["failed"] = [failed for _, failed in results]
        yield out


def _read_one(readers: dict[str, Callable[[bytes], str]], path: str, content: bytes) -> tuple[str, bool]:
    name = path.rsplit("/", 1)[-1]
    try:
        return readers[name.rsplit(".", 1)[-1].lower()](content), False
    except Exception as problem:  # one bad file must not fail the task
        return f"(error reading {name}: {problem})", True


def _mail_reader() -> Callable[[bytes], str]:
    """A reader of mail bodies. It keeps parsed headers, since the same few recur and parsing them is most of the work."""
    kept = policy.default.clone(header_factory=lru_cache(maxsize=512)(HeaderRegistry()))

    def read(content: bytes) -> str:
        message = BytesParser(policy=kept).parsebytes(content)
        body = message.get_body(preferencelist=("plain", "html"))
        return body.get_content() if body else content.decode("utf-8", errors="replace")

    return read


def _word_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    body = root.find(f"{_WORD}body")
    paragraphs = ["".join(_run_text(p)) for p in (body if body is not None else ()) if p.tag == f"{_WORD}p"]
    return "\n".join(p for p in paragraphs if p.strip())


def _run_text(paragraph: ElementTree.Element) -> Iterator[str]:
    """Text of the runs in a paragraph and in its links; page and column breaks give nothing."""
    marks = {f"{_WORD}tab": "\t", f"{_WORD}ptab": "\t", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}
    for child in paragraph:
        for run in child if child.tag == f"{_WORD}hyperlink" else (child,):
            for part in run if run.tag == f"{_WORD}r" else ():
                if part.tag == f"{_WORD}t":
                    yield part.text or ""
                elif part.tag == f"{_WORD}br":
                    yield "\n" if part.get(f"{_WORD}type", "textWrapping") == "textWrapping" else ""
                else:
                    yield marks.get(part.tag, "")


def _sheet_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = _shared_strings(archive) if "xl/sharedStrings.xml" in names else []
        links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = {link.get("Id"): link.get("Target", "") for link in links}
        sheets = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
        lines: list[str] = []
        for _, sheet in zip(range(SHEETS), sheets):
            lines.append(f"=== Sheet: {sheet.get('name')} ===")
            target = targets[sheet.get(f"{_REL}id")]
            file = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            lines.extend(_sheet_lines(ElementTree.fromstring(archive.read(file)), shared))
    return "\n".join(lines)


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in root.iter(f"{_SHEET}si")]


def _sheet_lines(sheet: ElementTree.Element, shared: list[str]) -> Iterator[str]:
    for at, row in enumerate(sheet.iter(f"{_SHEET}row"), start=1):
        if int(row.get("r", at)) > SHEET_ROWS:
            return
        cells = [""] * SHEET_COLUMNS
        for place, cell in enumerate(row.iter(f"{_SHEET}c")):
            column = _column_of(cell.get("r", ""), place)
            if column < SHEET_COLUMNS:
                cells[column] = _cell_text(cell, shared)
        if any(cells):
            yield "\t".join(cells)


def _column_of(reference: str, place: int) -> int:
    letters = [c for c in reference if c.isalpha()]
    if not letters:
        return place
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter.upper()) - ord("A") + 1
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    value = cell.findtext(f"{_SHEET}v", "")
    if kind == "s":
        return shared[int(value)]
    return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value


# Workers get this module's functions with the job, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
