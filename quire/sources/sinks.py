"""Results as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """A header, and nothing for null. With ``mark`` every file begins with a byte-order mark, as spreadsheets want it."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summaries(df: DataFrame, path: str) -> None:
    """``df(method, summary)`` as text files below a folder for each method, whose name is made safe."""
    df.select(t.safe_name(F.col("method")).alias("method"), "summary").write.mode("overwrite").partitionBy("method").text(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; a report's rows are few, more than ``most`` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([show(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def export_text(df: DataFrame) -> DataFrame:
    """(doc_id, content) of ``df(doc_id, title, summary)`` as plain text."""
    return df.select("doc_id", F.concat_ws("\n\n", "title", "summary").alias("content"))


def docx(title: str, text: str) -> bytes:
    """A small Word file: a bold title, then a paragraph for each line."""
    para = lambda x, bold="": f'<w:p><w:r>{bold}<w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'
    body = para(title, "<w:rPr><w:b/></w:rPr>") + "".join(para(x) for x in text.split("\n") if x.strip())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def export_docx(df: DataFrame) -> DataFrame:
    """(doc_id, content binary) of ``df(doc_id, title, summary)`` as Word files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [docx(a or "", x or "") for a, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return df.select(F.col("doc_id").cast("string"), "title", "summary").mapInArrow(run, "doc_id string, content binary")
