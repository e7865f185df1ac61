"""Document files as rows. Files are read by Spark's own readers, so any store works; what can't be parsed becomes an error
column and never fails a job.

A document row: path, name, paragraphs, source_type, pages, used_ocr, warnings, error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t
from quire.functions import values as v
from quire.sources.pdf import pdf_documents

EXTENSIONS = (".pdf", ".docx", ".pptx", ".txt", ".png", ".jpg", ".jpeg")
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}
SCHEMA = "path string, name string, paragraphs array<string>, source_type string, pages int, used_ocr boolean, warnings array<string>, error string"

OCR_WARNING, EMPTY_FILE, NO_TEXT, NO_ENCODING, NO_OCR = v.OCR_WARNING, v.EMPTY_FILE, v.NO_TEXT, v.NO_ENCODING, v.NO_OCR

Parsed = tuple[list[str], str, int | None, bool, list[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


class Unreadable(Exception):
    """A file that can't be read, with a message for its user."""


def parse_txt(content: bytes) -> Parsed:
    for encoding in ("utf-8-sig", "utf-16", "cp1258", "cp1252"):
        try:
            text = content.decode(encoding)
        except UnicodeError:
            continue
        return [p.strip() for p in text.replace("\r\n", "\n").split("\n\n") if p.strip()], "txt", None, False, []
    raise Unreadable(v.NO_ENCODING)


def _word_text(node: ElementTree.Element) -> str:
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in node.iter()).strip()


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs and table rows in order; cells stand between bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append(_word_text(child))
        elif child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                cells = ["\n".join(filter(None, (_word_text(p) for p in c.iter(f"{_W}p")))) for c in row.findall(f"{_W}tc")]
                out.append(" | ".join(cells) if any(cells) else "")
    return [p for p in out if p], "docx", None, False, []


def _ended(text: str) -> str:
    text = text.strip()
    return text if text.endswith((".", "!", "?", ":", ";")) else text + "."


def _runs(node: ElementTree.Element) -> list[str]:
    return ["".join(x.text or "" for x in p.iter(f"{_A}t")).strip() for p in node.iter(f"{_A}p")]


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id to (type, part) of what a part refers to."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    found = ElementTree.fromstring(z.read(rels)) if rels in z.namelist() else ()
    return {x.get("Id"): (x.get("Type", ""), posixpath.normpath(posixpath.join("/", folder, x.get("Target", "")))[1:]) for x in found}


def _slides(z: zipfile.ZipFile) -> list[tuple[str, str | None]]:
    """(slide, its notes) in the presentation's order; by file number only where nothing says otherwise."""
    there = set(z.namelist())
    numbered = sorted((n for n in there if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    parts = _related(z, "ppt/presentation.xml")
    listed = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId") if "ppt/presentation.xml" in there and parts else ()
    order = [parts[x.get(f"{_R}id")][1] for x in listed if x.get(f"{_R}id") in parts] or numbered
    out = []
    for name in filter(there.__contains__, order):
        own = _related(z, name)
        same = name.replace("slides/slide", "notesSlides/notesSlide")
        notes = next((part for kind, part in own.values() if kind.endswith("/notesSlide")), None) if own else same
        out.append((name, notes if notes in there else None))
    return out


def parse_pptx(content: bytes, furniture: bool = True) -> Parsed:
    """Slides in order: each shape's paragraphs and table rows, then the notes; each ends like a sentence.
    Without ``furniture`` slide numbers, footers, headers and dates are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = _slides(z)
        for name, notes in names:
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if shape.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                    continue
                holder = shape.find(f".//{_P}ph")
                if not furniture and holder is not None and holder.get("type") in ("sldNum", "ftr", "dt", "hdr"):
                    continue
                if shape.tag == f"{_P}sp":
                    out += [_ended(x) for x in _runs(shape) if x]
                for row in shape.iter(f"{_A}tr"):
                    cells = ["\n".join(filter(None, _runs(c))) for c in row.findall(f"{_A}tc")]
                    if any(cells):
                        out.append(_ended(" | ".join(cells)))
            if notes:
                bodies = [s for s in ElementTree.fromstring(z.read(notes)).iter(f"{_P}sp") if (h := s.find(f".//{_P}ph")) is not None and h.get("type") == "body"]
                said = "\n".join(x for s in bodies for x in _runs(s) if x).strip()
                if said:
                    out.append(_ended(said))
    return out, "pptx", len(names), False, []


def parse(name: str, content: bytes | None, ocr: Callable[[bytes, str], str] | None = None, furniture: bool = True) -> Parsed:
    """One file's paragraphs; raises ``Unreadable`` with a message. PDF files are read by ``pdf``, over all their pages."""
    dot = name.rfind(".")
    kind = name[dot:].lower() if dot > 0 else ""
    if kind not in EXTENSIONS:
        raise Unreadable(v.UNSUPPORTED.format(kind=kind or v.NO_KIND, known=", ".join(EXTENSIONS)))
    if not content:
        raise Unreadable(v.EMPTY_FILE)
    try:
        if kind == ".txt":
            got = parse_txt(content)
        elif kind == ".docx":
            got = parse_docx(content)
        elif kind == ".pptx":
            got = parse_pptx(content, furniture)
        elif ocr is None:
            raise Unreadable(v.NO_OCR)
        else:
            text = ocr(content, IMAGES[kind])
            got = [text] if text.strip() else [], "image", None, True, [v.OCR_WARNING]
    except Unreadable:
        raise
    except Exception as e:
        raise Unreadable(v.UNREADABLE.format(kind=kind, why=e)) from e
    if not "".join(got[0]).strip():
        raise Unreadable(v.NO_TEXT)
    return got


def parse_files(files: DataFrame, make_ocr: Callable[[], Callable[[bytes, str], str]] | None = None, furniture: bool = True, pdf: bool = True) -> DataFrame:
    """Document rows of ``files(path, content)``; further columns are carried along after them.

    PDF files take a way of their own, as rows of blocks; ``pdf`` false leaves it out where there are none.
    """
    if pdf:
        is_pdf = t.extension(F.coalesce("path", F.lit(""))).eqNullSafe(".pdf") & (F.length("content") > 0)
        return parse_files(files.where(~F.coalesce(is_pdf, F.lit(False))), make_ocr, furniture, False).unionByName(_parse_pdfs(files.where(is_pdf), make_ocr, furniture))
    more = [c for c in files.columns if c not in ("path", "content")]
    kinds = dict(files.dtypes)
    schema = SCHEMA + "".join(f", `{c}` {kinds[c]}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ocr = make_ocr() if make_ocr else None
        text = pa.list_(pa.string())
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = (path or "").rsplit("/", 1)[-1]
                try:
                    rows.append((path, name, *parse(name, content, ocr, furniture), None))
                except Unreadable as e:
                    rows.append((path, name, [], None, None, False, [], str(e)))
            types = (pa.string(), pa.string(), text, pa.string(), pa.int32(), pa.bool_(), text, pa.string())
            cols = [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(c) for c in more)], ["path", "name", "paragraphs", "source_type", "pages", "used_ocr", "warnings", "error", *more])

    return files.select("path", "content", *more).mapInArrow(run, schema)


def _parse_pdfs(files: DataFrame, make_ocr: Callable | None, furniture: bool) -> DataFrame:
    docs = pdf_documents(files.withColumn("doc_id", F.expr("uuid()")), make_ocr, furniture)
    blank = F.trim(F.array_join("paragraphs", "")) == ""
    docs = docs.withColumn("error", F.coalesce("error", F.when(blank, F.lit(v.NO_TEXT))))
    good = F.col("error").isNull()
    none = F.array().cast("array<string>")
    name = F.regexp_extract("info.path", r"([^/]*)$", 1)
    more = [F.col(f"info.`{c}`").alias(c) for c in files.columns if c not in ("path", "content")]
    return docs.select(
        F.col("info.path").alias("path"), name.alias("name"), F.when(good, F.col("paragraphs")).otherwise(none).alias("paragraphs"), F.when(good, F.col("source_type")).alias("source_type"),
        F.when(good, F.col("pages")).alias("pages"), (good & F.col("used_ocr")).alias("used_ocr"), F.when(good, F.col("warnings")).otherwise(none).alias("warnings"), "error", *more,
    )


def read_files(spark: SparkSession, path: str, glob: str = "*", make_ocr: Callable | None = None, furniture: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse_files(files.select("path", "content"), make_ocr, furniture)


def read_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, paragraphs) of UTF-8 files, with no Python at all."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    text = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), "^﻿", "")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.filter(F.transform(F.split(text, "\n\n"), t.strip), lambda p: p != "").alias("paragraphs"))


def benchmark_cases(docs: DataFrame) -> DataFrame:
    """(stem, path, paragraphs, reference): documents with the text of ``stem.ref.txt`` where there is one. ``docs``: path, paragraphs."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = docs.withColumn("_name", name).where(t.extension(name).isin(*EXTENSIONS))
    refs = rows.where(F.col("_name").endswith(".ref.txt")).select(F.regexp_replace("_name", r"\.ref\.txt$", "").alias("stem"), F.array_join("paragraphs", "\n\n").alias("reference"))
    cases = rows.where(~F.col("_name").endswith(".ref.txt")).withColumn("stem", F.regexp_replace("_name", r"\.[^.]*$", ""))
    return cases.join(refs, "stem", "left").select("stem", "path", "paragraphs", "reference")


def labelled_corpus(spark: SparkSession, root: str, size: int = 150) -> DataFrame:
    """(grp, label, chunk_no, text) of ``root/<label>/<file>.txt``; unknown folders keep their names."""
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = raw.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+/[^/]+)$", 1).alias("grp"), "value")
    names = F.create_map(*(F.lit(x) for pair in v.FOLDER_LABELS.items() for x in pair))
    return rows.select("grp", F.coalesce(F.element_at(names, F.lower("folder")), "folder").alias("label"), F.posexplode(arrow.word_chunks(F.col("value"), size)).alias("chunk_no", "text"))


def html_pages(pages: DataFrame, least_words: int = 0) -> DataFrame:
    """(page_id, text) of ``pages(page_id, html)`` with at least so many words."""
    rows = pages.select("page_id", arrow.html_text(F.col("html")).alias("text"))
    return rows.where(F.size(t.words(F.col("text"))) >= least_words) if least_words else rows


def new_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What a fetch still has to get."""
    return found.join(known.select(key).distinct(), key, "left_anti")
