"""Documents from files: Markdown, text, DOCX and PDF, read in parallel as bytes.

A file that can't be read gives a row with its error instead of failing the scan.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from orrery.functions import text as T

KINDS = ("pdf", "docx", "md", "markdown", "txt")
PARSED = Y.StructType([Y.StructField("text", Y.StringType()), Y.StructField("metadata", Y.MapType(Y.StringType(), Y.StringType())), Y.StructField("error", Y.StringType())])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str:
    """UTF-8, else GBK."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("gbk")


def read_docx(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs that aren't blank, then table rows with cells joined by bars."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    body = root.find(f"{_W}body")
    paras = [t for p in body.findall(f"{_W}p") if (t := words(p))]
    tables = body.findall(f"{_W}tbl")
    rows = [" | ".join(cells) for tb in tables for tr in tb.iter(f"{_W}tr") if (cells := [t for tc in tr.findall(f"{_W}tc") if (t := words(tc))])]
    return "\n\n".join(paras + rows), {"paragraphs": str(len(paras)), "tables": str(len(tables))}


def read_pdf(data: bytes) -> tuple[str, dict[str, str]]:
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        raise ValueError("PDF support (pdfminer) isn't installed") from None
    text = extract_text(io.BytesIO(data))
    if not text.strip():
        raise ValueError("no text in the PDF")
    return text, {"pages": str(len(re.findall(rb"/Type\s*/Page\b", data)))}


def parse_bytes(ext: str, data: bytes) -> tuple[str, dict[str, str]]:
    if ext not in KINDS:
        raise ValueError(f"unsupported file type: {ext}")
    if ext == "pdf":
        return read_pdf(data)
    if ext == "docx":
        return read_docx(data)
    text = decode(data)
    return text, {"headings": str(len(re.findall(r"(?m)^#{1,6}\s+", text)))} if ext != "txt" else {}


@F.pandas_udf(PARSED)
def parse_udf(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
    out = []
    for e, b in zip(ext, data):
        try:
            out.append((*parse_bytes(e, b), None))
        except Exception as x:  # noqa: BLE001  one bad file is one error row
            out.append((None, None, f"{type(x).__name__}: {x}"[:300]))
    return pd.DataFrame(out, columns=["text", "metadata", "error"])


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, source_file, file_type, text, metadata, error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = raw.select("path", name.alias("source_file"), ext.alias("file_type"), F.when(ext.isin(*KINDS), F.col("content")).alias("content"))
    p = known.withColumn("p", parse_udf("file_type", "content"))
    return p.select("path", "source_file", "file_type", T.normalize(F.col("p.text")).alias("text"), "p.metadata", "p.error")


def scan_markdown(spark: SparkSession, path: str, least: int = 500, exclude: tuple[str, ...] = ("node_modules", ".git", "venv", "__pycache__")) -> DataFrame:
    """Markdown files of ``least`` bytes and more outside the excluded folders, by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    out = ~F.exists(F.split("path", "/"), lambda x: x.isin(*exclude))
    return raw.where((F.col("length") >= least) & out).select("path", "length").orderBy("path")
