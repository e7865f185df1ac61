"""PDF files made here: blocks, furniture across pages, scans, damage."""

import sys
import types
import zlib

import pytest

from quire.functions import values as v
from quire.sources import pdf, readers


def made(pages, *, flate=True, objstm=False, cmap=False):
    """A PDF whose pages are lists of (x, y from below, text); later strings of a block follow 14 below."""
    objects, kids = [], []

    def stream(data, head=""):
        body = zlib.compress(data) if flate else data
        return f"<< /Length {len(body)} {'/Filter /FlateDecode' if flate else ''} {head}>>\nstream\n".encode() + body + b"\nendstream"

    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    if cmap:
        table = b"1 beginbfchar\n<0041> <1EA1>\nendbfchar\n1 beginbfrange\n<0061> <007A> <0061>\nendbfrange"
        objects.append((50, stream(table)))
        font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 50 0 R >>"
    objects += [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (3, font)]
    for i, lines in enumerate(pages):
        show = lambda t: f"<{t.encode('utf-16-be').hex()}>" if cmap else "(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
        text = "q BT /F1 12 Tf 14 TL\n" + "\n".join(f"1 0 0 1 {x} {y} Tm " + " T* ".join(f"{show(part)} Tj" for part in t.split("\n")) for x, y, t in lines) + "\nET Q"
        objects.append((10 + 2 * i, f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()))
        objects.append((11 + 2 * i, stream(text.encode("cp1252"))))
        kids.append(f"{10 + 2 * i} 0 R")
    objects.append((2, f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Kids [{' '.join(kids)}] >>".encode()))
    if objstm:
        plain = [o for o in objects if b"stream" not in o[1]]
        at, head, body = 0, [], b""
        for n, x in plain:
            head.append(f"{n} {at}")
            body += x + b" "
            at = len(body)
        first = (" ".join(head) + " ").encode()
        objects = [o for o in objects if b"stream" in o[1]] + [(90, stream(first + body, f"/Type /ObjStm /N {len(plain)} /First {len(first)} "))]
    return b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + x + b"\nendobj\n" for n, x in objects) + b"trailer << /Root 1 0 R >>\n%%EOF"


def book(n=5):
    """Pages with a header, two body blocks whose sentence runs over the page, a page number and a margin note of one page."""
    return [[(50, 780, f"The Book - part {i}"), (50, 600, f"Page text {i} goes on\nover two lines with body and body and body."), (50, 400, f"It (really) {i} ends here but"), (50, 20, f"- {i + 1} -"), *([(300, 20, "only once")] if i == 2 else [])] for i in range(n)]


@pytest.mark.parametrize("kind", ({}, {"flate": False}, {"objstm": True}, {"cmap": True}))
def test_plain_blocks(kind):
    pages, blocks = pdf.plain_blocks(made(book(2), **kind))
    if kind.get("cmap"):  # only what the table has: no blanks, no digits, one capital
        assert [b[7] for b in blocks[:3]] == ["heookpart", "agetextgoeson\novertwolineswithbodyandbodyandbody", "treallyendsherebut"] and len(blocks) == 6
        return
    assert pages == 2 and [b[7] for b in blocks[:4]] == ["The Book - part 0", "Page text 0 goes on\nover two lines with body and body and body.", "It (really) 0 ends here but", "- 1 -"]
    assert [b[0] for b in blocks] == [0] * 4 + [1] * 4 and blocks[0][6] <= 72 and blocks[3][4] >= 728 and 100 < blocks[1][4] < blocks[1][6] < 300


def test_signs_of_a_table_and_of_escapes():
    assert pdf._decoded(b"\x00A\x00b", {0x41: "ạ", 0x62: "b"}, True) == "ạb"
    assert [*pdf._tokens(rb"[(a\)\050\\ (b)) -250 (c)] TJ <4 1> /N#1 % x")] == ["[", b"a)(\\ (b)", -250, b"c", "]", "TJ", b"A", "/N#1"]


def test_furniture_goes_over_all_pages(spark):
    files = spark.createDataFrame([("d/book.pdf", made(book()), 7), ("d/bad.pdf", b"%PDF nothing", 8), ("d/no.PDF", b"nothing", 9), ("d/a.txt", b"plain text", 10)], "path string, content binary, batch int")
    got = {r.name: r for r in readers.parse_files(files).collect()}
    words = " ".join(got["book.pdf"].paragraphs)
    assert len(got) == 4 and got["book.pdf"].pages == 5 and got["book.pdf"].batch == 7 and got["a.txt"].paragraphs == ["plain text"]
    assert "The Book" not in words and "- 1 -" not in words and "only once" in words
    assert got["book.pdf"].paragraphs[1] == "It (really) 0 ends here but Page text 1 goes on over two lines with body and body and body."
    assert got["bad.pdf"].error and got["no.PDF"].error and got["bad.pdf"].paragraphs == []
    kept = {r.name: r for r in readers.parse_files(files, furniture=False).collect()}["book.pdf"]
    assert "The Book - part 0" in " ".join(kept.paragraphs) and "- 1 -" in " ".join(kept.paragraphs)


def test_passwords_and_scans(spark):
    locked = made(book(1)).replace(b"trailer << ", b"trailer << /Encrypt 9 0 R ")
    few = made([[(50, 400, "Hi")], []])
    margin_only = made([[(50, 780, "A running header that repeats on every single page of it"), (50, 400, "x")] for _ in range(3)])
    files = spark.createDataFrame([("l.pdf", locked), ("f.pdf", few), ("m.pdf", margin_only)], "path string, content binary")
    got = {r.name: r for r in readers.parse_files(files).collect()}
    assert got["l.pdf"].error == v.PDF_PASSWORD and got["f.pdf"].error == got["m.pdf"].error == v.PDF_NO_OCR


class _Page:
    def __init__(self, n):
        self.n, self.rect = n, types.SimpleNamespace(height=800.0)

    def get_text(self, kind):
        return []

    def get_pixmap(self, dpi):
        return types.SimpleNamespace(tobytes=lambda kind: f"{kind} {dpi} {self.n}".encode())


class _Pdf(list):
    needs_pass = False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_scans_are_read_by_ocr(monkeypatch):
    """The drawing library is a stand-in, so this runs where it does: not in a worker."""
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: _Pdf(_Page(i) for i in range(12))))
    assert pdf.blocks_of(b"x") == (12, []) and pdf._may_be_scan(12, [], 0.09)


OCR = """
class Page:
    def __init__(self, n):
        import types
        self.n, self.rect = n, types.SimpleNamespace(height=800.0)
    def get_text(self, kind):
        return []
    def get_pixmap(self, dpi):
        import types
        return types.SimpleNamespace(tobytes=lambda kind: str(self.n).encode())
class Pdf(list):
    needs_pass = False
    def __enter__(self):
        return self
    def __exit__(self, *_):
        return None
def open(stream, filetype):
    return Pdf(Page(i) for i in range(len(stream)))
"""


def test_scanned_pages_lose_repeated_lines(spark, tmp_path):
    (tmp_path / "pymupdf.py").write_text(OCR)
    spark.sparkContext.addPyFile(str(tmp_path / "pymupdf.py"))
    make = lambda: lambda png, mime: f"Header of it\n{'abcdefghijkl'[int(png)]} begins\nbody\n{'abcdefghijkl'[int(png)]} ends\nPage {int(png)}"
    sys.modules.pop("pymupdf", None)
    files = spark.createDataFrame([("s.pdf", b"x" * 12), ("t.pdf", b"x" * 2)], "path string, content binary")
    got = {r.name: r for r in readers.parse_files(files, make).collect()}
    s = got["s.pdf"]
    assert s.used_ocr and s.pages == 12 and len(s.paragraphs) == 10 and s.source_type == "pdf (scan)" and s.warnings == [v.PDF_MANY_PAGES.format(most=10) % 12, v.OCR_WARNING]
    assert s.paragraphs[3] == "d begins\nbody\nd ends"
    assert got["t.pdf"].paragraphs[0].startswith("Header") and got["t.pdf"].warnings == [v.OCR_WARNING]
