"""PDF files as rows of text blocks, filtered by rules over all pages of a file before paragraphs are made of them.

A file gives one head row and a row for each block (page, position, corners, text, type). With ``pymupdf`` blocks are that
library's; without it a small reader takes the text of plain PDFs (Flate or uncompressed streams, object streams, simple fonts
and ToUnicode tables). OCR needs ``pymupdf``, which draws the pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import values as v
from quire.operators import layout
from quire.session import checkpoint

BLOCK = "page_no int, page_h double, block_pos int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
HEAD = "doc_id string, pages int, content binary, error string"
#: A page of fewer signs on average is a scanned one; pages beyond this number are not read by OCR.
LEAST_CHARS, MOST_OCR = 50, 10

Block = tuple[int, float, int, float, float, float, float, str, int]


class Broken(Exception):
    """A PDF that can't be read, with a message for its user."""


# --- a reader of plain PDFs ------------------------------------------------------------------------------------------

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%{}]*|\(|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][\w'\"*]*|[{}]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Ref(int):
    """The number of another object."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket ends before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                nxt = data[at : at + 1]
                out += b"" if nxt in b"\r\n" else _ESCAPES.get(nxt, nxt)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[object]:
    """Numbers, strings (bytes), names and operators (str) and brackets of an object or a page's content."""
    at = 0
    while m := _TOKEN.search(data, at):
        x, at = m[0], m.end()
        if x[:1] == b"%":
            continue
        if x == b"(":
            text, at = _literal(data, at)
            yield text
        elif x[:1] == b"<" and x != b"<<":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", x)
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", x):
            yield float(x) if b"." in x else int(x)
        else:
            yield x.decode("latin-1")
            if x == b"ID":  # an inline image's bytes
                end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
                at = end.end() if end else len(data)


def _value(data: bytes) -> object:
    """The object that ``data`` begins with: dict, list, ``_Ref`` or what a token is."""
    stack: list[list] = [[]]
    for x in _tokens(data):
        if x in ("<<", "["):
            stack.append([])
        elif x in (">>", "]") and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(dict(zip([str(k)[1:] for k in done[::2]], done[1::2], strict=False)) if x == ">>" else done)
        elif x == "R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            stack[-1][-2:] = [_Ref(stack[-1][-2])]
        elif x in ("stream", "endobj"):
            break
        else:
            stack[-1].append(x)
    return stack[0][0] if stack[0] else None


class _File:
    def __init__(self, content: bytes) -> None:
        if not content.lstrip().startswith(b"%PDF"):
            raise Broken("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise Broken(v.PDF_PASSWORD)
        self.raw = {int(m[1]): m[2] for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b(.*?)endobj", content, re.S)}
        for body in [b for b in self.raw.values() if b"/ObjStm" in b]:
            head, data = _value(body), self.stream(body)
            numbers = [int(x) for x in data[: head["First"]].split()]
            starts = numbers[1::2]
            for n, a, b in zip(numbers[::2], starts, [*starts[1:], len(data)], strict=True):
                self.raw.setdefault(n, data[head["First"] + a : head["First"] + b])

    def get(self, x: object) -> object:
        return _value(self.raw.get(int(x), b"")) if isinstance(x, _Ref) else x

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*)endstream", body, re.S)
        if not m:
            return b""
        kind = (_value(body) or {}).get("Filter")
        names = [kind] if isinstance(kind, str) else kind or []
        if names not in ([], ["/FlateDecode"]):
            return b""
        return zlib.decompressobj().decompress(m[1]) if names else m[1]

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        roots = [x for b in self.raw.values() if b"/Catalog" in b and isinstance(x := _value(b), dict) and x.get("Type") == "/Catalog"]
        if not roots:
            raise Broken("no pages")
        todo, seen = [(roots[-1].get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, _Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, _Ref) else id(node))
            node = {k: x for k, x in above.items() if k in ("MediaBox", "Resources")} | node
            if "Kids" in node:
                todo += [(k, node) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node

    def contents(self, page: dict) -> bytes:
        refs = page.get("Contents")
        refs = refs if isinstance(refs, list) else self.get(refs) if isinstance(self.get(refs), list) else [refs]
        return b"\n".join(self.stream(self.raw.get(int(r), b"")) for r in refs if isinstance(r, _Ref))

    def decoders(self, page: dict) -> dict[str, Callable[[bytes], str]]:
        """How each font of the page turns bytes into text."""
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        out = {}
        for name, ref in fonts.items():
            font = self.get(ref) or {}
            table = _unicode_table(self.stream(self.raw.get(int(font["ToUnicode"]), b""))) if isinstance(font.get("ToUnicode"), _Ref) else {}
            wide = font.get("Subtype") == "/Type0"
            out["/" + name] = lambda b, table=table, wide=wide: _decoded(b, table, wide)
        return out


def _unicode_table(cmap: bytes) -> dict[int, str]:
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + i] = chr(int(c, 16) + i) if len(c) <= 4 else bytes.fromhex(c.decode()).decode("utf-16-be", "replace")
    return out


def _decoded(raw: bytes, table: dict[int, str], wide: bool) -> str:
    if not wide:
        return "".join(table.get(c) or bytes([c]).decode("cp1252", "replace") for c in raw)
    return "".join(table.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))


def _shown(content: bytes, decoders: dict) -> Iterator[tuple[float, float, float, str]]:
    """(x, y, size, text) of every string that a page's content shows, upright text only."""
    stack: list = []
    line = place = (1.0, 0.0, 0.0)  # scale, x, y
    size, lead, decode = 12.0, 0.0, lambda b: _decoded(b, {}, False)
    moved, saved = (1.0, 0.0, 0.0), []
    for x in _tokens(content):
        if not isinstance(x, str) or x[:1] == "/" or x in ("[", "]", "<<", ">>"):
            stack.append(x)
            continue
        n = [a for a in stack if isinstance(a, (int, float))]
        if x == "BT":
            line = place = (1.0, 0.0, 0.0)
        elif x == "q":
            saved.append(moved)
        elif x == "Q" and saved:
            moved = saved.pop()
        elif x == "cm" and len(n) >= 6:
            moved = (moved[0] * n[-3], moved[1] + moved[0] * n[-2], moved[2] + moved[0] * n[-1])
        elif x == "Tf" and n:
            size, decode = n[-1], decoders.get(next((a for a in stack if isinstance(a, str)), ""), decode)
        elif x == "TL" and n:
            lead = n[-1]
        elif x in ("Td", "TD") and len(n) >= 2:
            lead = -n[-1] if x == "TD" else lead
            line = place = (line[0], line[1] + line[0] * n[-2], line[2] + line[0] * n[-1])
        elif x == "Tm" and len(n) >= 6:
            line = place = (n[-3] or 1.0, n[-2], n[-1])
        elif x == "T*" or x in ("'", '"'):
            line = place = (line[0], line[1], line[2] - line[0] * lead)
        if x in ("Tj", "TJ", "'", '"'):
            text = "".join(decode(a) if isinstance(a, bytes) else " " if isinstance(a, (int, float)) and a < -200 and x == "TJ" else "" for a in stack)
            high = abs(size * place[0] * moved[0])
            yield moved[1] + moved[0] * place[1], moved[2] + moved[0] * place[2], high, text
            place = (place[0], place[1] + size * place[0] * len(text) / 2, place[2])
        stack = []


def plain_blocks(content: bytes) -> tuple[int, list[Block]]:
    """(pages, blocks): strings of one height are lines, lines that follow closely are blocks; y grows downwards."""
    file, out, n = _File(content), [], 0
    for n, page in enumerate(file.pages(), 1):
        box = [float(x) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        height, lines = box[3] - box[1], []
        for x, y, size, text in _shown(file.contents(page), file.decoders(page)):
            if lines and abs(lines[-1][1] - y) < size / 4:
                gap = " " if x > lines[-1][4] + size / 4 else ""
                lines[-1][3] += gap + text
                lines[-1][4] = x + size * len(text) / 2
            elif text.strip():
                lines.append([x, y, size, text, x + size * len(text) / 2])
        blocks: list[list] = []
        for x, y, size, text, right in lines:
            if blocks and 0 < blocks[-1][1] - y <= 1.6 * size and abs(blocks[-1][0] - x) < 4 * size:
                blocks[-1][1], blocks[-1][3], blocks[-1][4] = y, blocks[-1][3] + "\n" + text, max(blocks[-1][4], right)
            else:
                blocks.append([x, y, size, text, right, y + size])
        for i, (x, y, size, text, right, top) in enumerate(blocks):
            out.append((n - 1, height, i, x, height - (top - box[1]), right, height - (y - size / 4 - box[1]), text, 0))
    return n, out


# --- blocks as rows --------------------------------------------------------------------------------------------------


def blocks_of(content: bytes) -> tuple[int, list[Block]]:
    """(pages, blocks) of a file; raises ``Broken``."""
    try:
        import pymupdf
    except ImportError:
        return plain_blocks(content)
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if pdf.needs_pass:
            raise Broken(v.PDF_PASSWORD)
        return len(pdf), [(i, p.rect.height, j, *b[:5], b[6] if len(b) > 6 else 0) for i, p in enumerate(pdf) for j, b in enumerate(p.get_text("blocks"))]


def _may_be_scan(pages: int, blocks: list[Block], margin: float) -> bool:
    """Whether the text that no filter can take away is too little."""
    sure = sum(len(b[7].strip()) for b in blocks if not b[8] and (b[1] <= 0 or not (b[6] <= b[1] * margin or b[4] >= b[1] * (1 - margin))))
    return sure < LEAST_CHARS * max(1, pages)


def pdf_blocks(files: DataFrame, margin: float = 0.09) -> DataFrame:
    """A head row (doc_id, pages, content, error, info) and block rows (page_no, ..., block_type) for each of ``files`` (doc_id, content, more).

    info holds the further columns. The content is carried only where a file may turn out to be a scan. Files that can't be
    read have an error and no blocks.
    """
    more = [F.col(f"`{c}`") for c in files.columns if c not in ("doc_id", "content")]
    src = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content", F.struct(*more or [F.lit(0).alias("none")]).alias("info"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in f"{HEAD}, {BLOCK}".split(", ")]
        types = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.int32()]
        for b in batches:
            for at, (doc, content) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                try:
                    pages, found = blocks_of(content)
                    rows = [(doc, pages, content if _may_be_scan(pages, found, margin) else None, None, *[None] * 9)]
                    rows += [(doc, None, None, None, *x) for x in found]
                except Broken as e:
                    rows = [(doc, None, None, str(e), *[None] * 9)]
                except Exception as e:  # a damaged file is a row with an error, whatever it breaks
                    rows = [(doc, None, None, v.UNREADABLE.format(kind=".pdf", why=e), *[None] * 9)]
                info = b.column(2).take(pa.array([at] + [None] * (len(rows) - 1), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)), info], [*names, "info"])

    return src.mapInArrow(run, f"{HEAD}, {BLOCK}, info {src.schema['info'].dataType.simpleString()}")


def _ocr_pages(files: DataFrame, make_ocr: Callable[[], Callable[[bytes, str], str]]) -> DataFrame:
    """(doc_id, page_no, text) of the first pages of ``files`` (doc_id, content), drawn and read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pymupdf

        ocr = make_ocr()
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    read = [ocr(pdf[i].get_pixmap(dpi=150).tobytes("png"), "image/png") for i in range(min(len(pdf), MOST_OCR))]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(read), pa.string()), pa.array(range(len(read)), pa.int32()), pa.array(read, pa.string())], ["doc_id", "page_no", "text"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, page_no int, text string")


def pdf_documents(files: DataFrame, make_ocr: Callable[[], Callable[[bytes, str], str]] | None = None, furniture: bool = True) -> DataFrame:
    """(doc_id, paragraphs, source_type, pages, used_ocr, warnings, error, info) of ``files`` (doc_id, content, more).

    Page numbers and lines that repeat in the margins go before blocks become paragraphs, unless ``furniture`` is false.
    A file with next to no text left is a scan: its first pages are read by OCR, their repeated edge lines go likewise.
    """
    rows = checkpoint(pdf_blocks(files))
    heads = rows.where("page_no is null").select("doc_id", "pages", "content", "error", "info")
    blocks = rows.where("page_no is not null").drop("pages", "content", "error", "info")
    if furniture:
        blocks = layout.filter_furniture(blocks, pages=heads.where("error is null").select("doc_id", F.col("pages").alias("n_pages")))
    placed = blocks.withColumn("pos", F.col("page_no").cast("long") * (1 << 20) + F.col("block_pos"))
    merged = layout.merge_blocks(placed).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_pos", "text"))).alias("p"))  # one file's own text
    texts = merged.select("doc_id", F.transform("p", lambda x: x["text"]).alias("paragraphs"))
    none = F.array().cast("array<string>")
    docs = heads.join(texts, "doc_id", "left").withColumn("paragraphs", F.coalesce("paragraphs", none))
    chars = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p))
    scan = F.col("error").isNull() & (chars < LEAST_CHARS * F.greatest("pages", F.lit(1)))
    docs = checkpoint(docs.withColumn("scan", scan))
    plain = docs.where("not scan").select("doc_id", "paragraphs", F.when(F.col("error").isNull(), F.lit("pdf")).alias("source_type"), "pages", F.lit(False).alias("used_ocr"), none.alias("warnings"), "error", "info")
    if make_ocr is None:
        blind = docs.where("scan").select("doc_id", none.alias("paragraphs"), F.lit(None).cast("string").alias("source_type"), "pages", F.lit(False).alias("used_ocr"), none.alias("warnings"), F.lit(v.PDF_NO_OCR).alias("error"), "info")
        return plain.unionByName(blind)
    read = _ocr_pages(docs.where("scan"), make_ocr)
    if furniture:
        read = checkpoint(read)
        lines = read.select("doc_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
        read = layout.strip_page_lines(lines)
    paged = read.where(r"text rlike '(?U)\\S'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    warnings = F.filter(F.array(F.when(F.col("pages") > MOST_OCR, F.format_string(v.PDF_MANY_PAGES.format(most=MOST_OCR), "pages")), F.lit(v.OCR_WARNING)), lambda w: w.isNotNull())
    seen = docs.where("scan").drop("paragraphs").join(paged, "doc_id", "left")
    seen = seen.select("doc_id", F.coalesce(F.transform("p", lambda x: x["text"]), none).alias("paragraphs"), F.lit("pdf (scan)").alias("source_type"), "pages", F.lit(True).alias("used_ocr"), warnings.alias("warnings"), "error", "info")
    return plain.unionByName(seen)
