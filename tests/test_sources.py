"""Readers and sinks on files written here."""

import io
import zipfile

from pyspark.sql import functions as F

from quire.operators import domain
from quire.plans import pipeline
from quire.sources import readers, sinks
from quire.streaming import describe, read_documents, write_described

A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"


def shape(*lines, holder=""):
    paras = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines)
    ph = f'<p:nvSpPr><p:nvPr><p:ph type="{holder}"/></p:nvPr></p:nvSpPr>' if holder else ""
    return f"<p:sp>{ph}<p:txBody>{paras}</p:txBody></p:sp>"


def slides():
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>c2</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        wrap = lambda body: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
        z.writestr("ppt/slides/slide10.xml", wrap(shape("Last")))
        z.writestr("ppt/slides/slide1.xml", wrap(shape("Title", holder="title") + shape("Body one", "Done!") + table + shape("Foot", holder="ftr") + shape("3", holder="sldNum")))
        z.writestr("ppt/notesSlides/notesSlide1.xml", wrap(shape("Say this", holder="body") + shape("1", holder="sldNum")))
    return out.getvalue()


def test_parsers():
    assert readers.parse_pptx(slides())[0] == ["Title.", "Body one.", "Done!", "c1 | c2.", "Foot.", "3.", "Say this.", "Last."]
    assert readers.parse_pptx(slides(), False)[0] == ["Title.", "Body one.", "Done!", "c1 | c2.", "Say this.", "Last."]
    assert readers.parse_docx(sinks.docx("A & B", "one\n\ntwo <x>"))[0] == ["A & B", "one", "two <x>"]
    assert readers.parse_txt("﻿a\r\n\r\nb\n\n \n\nc".encode())[0] == ["a", "b", "c"]
    assert readers.parse_txt("được".encode("utf-16"))[0] == ["được"]


def test_errors_are_a_column(spark):
    rows = [("d/a.txt", b"one\n\ntwo"), ("d/e.txt", b""), ("d/b.docx", b"broken"), ("d/x.exe", b"1"), ("d/noext", b"1"), ("d/i.PNG", b"img"), ("d/w.txt", b" \n\n ")]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("batch", F.lit(1))
    out = {r.name: r for r in readers.parse_files(files).collect()}
    assert out["a.txt"].paragraphs == ["one", "two"] and out["a.txt"].error is None and out["a.txt"].batch == 1
    assert out["e.txt"].error == readers.EMPTY_FILE and out["i.PNG"].error == readers.NO_OCR and out["w.txt"].error == readers.NO_TEXT
    assert ".docx" in out["b.docx"].error and ".exe" in out["x.exe"].error and "(không có)" in out["noext"].error
    seen = readers.parse_files(files.where("path = 'd/i.PNG'"), lambda: lambda content, mime: f"{mime} {len(content)}").first()
    assert seen.paragraphs == ["image/png 3"] and seen.used_ocr and seen.warnings == [readers.OCR_WARNING]


def test_folders(spark, tmp_path):
    (tmp_path / "nlp").mkdir()
    (tmp_path / "odd").mkdir()
    (tmp_path / "nlp" / "a.txt").write_text("w " * 60 + "\n\n" + "v " * 120)
    (tmp_path / "odd" / "b.txt").write_text("u " * 60)
    got = sorted((r.grp, r.label, r.chunk_no) for r in readers.labelled_corpus(spark, str(tmp_path)).collect())
    assert got == [("nlp/a.txt", "Natural Language Processing", 0), ("nlp/a.txt", "Natural Language Processing", 1), ("odd/b.txt", "odd", 0)]
    assert readers.read_files(spark, str(tmp_path), "*.txt").where("error is null").count() == 2


def test_cases_and_benchmark(spark, tmp_path):
    text = " ".join(f"Sentence {i} says something about topic {i % 3} here." for i in range(12))
    for name, x in {"one.txt": text, "one.ref.txt": "Sentence 1 says something about topic 1 here.", "two.txt": text, "skip.bin": "x"}.items():
        (tmp_path / name).write_text(x)
    cases = readers.benchmark_cases(readers.read_text(spark, str(tmp_path), "*"))
    assert {r.stem: r.reference is not None for r in cases.collect()} == {"one": True, "two": False}
    lex = domain.lexicon(spark, {"T": ["topic"]})
    extra = spark.createDataFrame([("one", "given", text)], "doc_id string, method string, summary string")
    rows, summary = pipeline.benchmark(cases, lex, extra=extra)
    assert {(r.doc_id, r.method) for r in rows.collect()} == {("one", "TextRank"), ("one", "TextRank + terms"), ("two", "TextRank"), ("two", "TextRank + terms"), ("one", "given")}
    rep = {r.method: r for r in summary.collect()}
    assert rep["TextRank"].n_docs == 2 and rep["TextRank"].rouge1_n == 1 and rep["given"].n_docs == 1


def test_fetch_helpers(spark):
    pages = spark.createDataFrame([(1, "<p>one two three</p>"), (2, "<p>one</p>")], "page_id int, html string")
    assert [r.page_id for r in readers.html_pages(pages, 2).collect()] == [1]
    assert readers.new_only(pages, pages.where("page_id = 1"), "page_id").first().page_id == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m é+", "sum", None)], "method string, summary string, x double")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert "m é+,sum,\n" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    sinks.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().summary == "sum"
    sinks.write_summaries(df, f"{tmp_path}/text")
    assert len(list((tmp_path / "text").glob("method=m*"))) == 1
    assert sinks.markdown_table(df).splitlines()[2] == "| m é+ | sum |  |"
    made = spark.createDataFrame([(1, "T", "a\nb")], "doc_id int, title string, summary string")
    assert sinks.export_text(made).first().content == "T\n\na\nb"
    assert readers.parse_docx(bytes(sinks.export_docx(made).first().content))[0] == ["T", "a", "b"]


class Copy:
    def complete(self, model, prompt):
        return prompt.split("\n\n", 1)[1]


def test_whole_runs(spark):
    from quire.operators import models

    text = "The Neural Network model (NN) learns. Neural Network models need data of 16 GB each. Data helps the Neural Network learn more. Other things are here too now."
    files = spark.createDataFrame([(1, [text, "Page 3", "y = Wx + b"]), (2, ["Short text only."])], "doc_id long, paragraphs array<string>")
    lex = domain.lexicon(spark, {"ML": ["neural network", "data"]}, {"ML": "Science"})
    call = lambda: models.Caller(Copy(), ("m",), delays=())
    out = {str(r.doc_id): r for r in pipeline.summarize(files, lex).collect()}
    one = out["1"]
    assert one.domain == "ML" and "Neural Network" in one.terms and one.abbreviations[0].long == "Neural Network model" and one.units == ["16 GB"] and one.formulas == ["y = Wx + b"]
    assert one.validation.n_sentences > 0 and not one.validation.unsupported_numbers
    made = {str(r.doc_id): r for r in pipeline.summarize(files, lex, call).collect()}
    assert "Thuật ngữ" in made["1"].summary and made["2"].summary == "Short text only."
    for make in (None, call):
        read = {str(r.doc_id): r.reading for r in pipeline.read_aloud(files, lex, make).collect()}
        assert "Page 3" not in read["1"] and read["1"].startswith("The Neural Network") and read["2"] == "Short text only."


def test_stream_is_the_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "documents.parquet").symlink_to(f"{src}/documents.parquet")
    q = write_described(read_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    want = describe(spark.read.parquet(f"{src}/documents.parquet"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_slides_in_the_presentation_s_order():
    """Slide 2 comes first and has the notes of file 1."""
    import io
    import zipfile

    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    r, rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    shape = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:sp>{{}}<a:p><a:r><a:t>{{}}</a:t></a:r></a:p></p:sp></p:sld>'
    body = '<p:nvPr><p:ph type="body"/></p:nvPr>'
    rels = lambda *xs: f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="{i}" Type="{r}/{k}" Target="{t}"/>' for i, k, t in xs) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("a", "slide", "slides/slide1.xml"), ("b", "slide", "/ppt/slides/slide2.xml")))
        z.writestr("ppt/slides/slide1.xml", shape.format("", "One"))
        z.writestr("ppt/slides/slide2.xml", shape.format("", "Two"))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels(("x", "slideLayout", "../slideLayouts/slideLayout1.xml")))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels(("x", "notesSlide", "../notesSlides/notesSlide1.xml")))
        z.writestr("ppt/notesSlides/notesSlide1.xml", shape.format(body, "Said"))
    assert readers.parse_pptx(out.getvalue())[0] == ["Two.", "Said.", "One."]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    import glob

    sinks.write_csv(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), f"{tmp_path}/x", mark=True)
    (one,) = glob.glob(f"{tmp_path}/x/*.csv")
    with open(one, "rb") as f:
        assert f.read() == "\ufeffa,b\n1,\n".encode()
