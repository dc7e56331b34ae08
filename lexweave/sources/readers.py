"""Reading records, documents and rules; files of pages come through a pluggable extractor.

All readers take explicit schemas or check required columns, and let extra columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.keys import reject_missing

PAGE_SCHEMA = "doc string, page_number int, text string, extraction_method string, char_count int, needs_ocr boolean, warning string, file_sha256 string"


def records(df: DataFrame, key: str = "clause_id", text: str = "clause_text") -> DataFrame:
    """Rows with a key; a null text becomes ''. Fails if a required column is missing; other columns pass."""
    reject_missing(df, key, text)
    return df.where(F.col(key).isNotNull()).withColumn(text, F.coalesce(text, F.lit("")))


def read_csv(spark: SparkSession, path: str, key: str = "clause_id", text: str = "clause_text", line_breaks: bool = True) -> DataFrame:
    """CSV with all columns as strings (nothing is inferred), with or without a byte order mark. With line_breaks, quoted values may hold
    them, and every file is read by one task; large files without such values are split over tasks with line_breaks=False."""
    return records(spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path), key, text)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of records, an object with such a list under `records`, or JSON lines, by an explicit schema."""
    whole = spark.read.schema(f"records array<struct<{_struct(schema)}>>, {schema}").option("multiLine", True).json(path)
    cols = [c.strip().split(" ", 1)[0] for c in _parts(schema)]
    nested = whole.where("records is not null").select(F.inline("records"))
    return nested.select(*cols).unionByName(whole.where("records is null").select(*cols))


def _parts(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _struct(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (p.strip().split(" ", 1) for p in _parts(schema)))


def union_of_splits(spark: SparkSession, *paths: str, key: str = "clause_id", fallback: str | None = None) -> DataFrame:
    """The tables of all paths that exist, one after the other: of rows with the same key, the one of the first path that has it (any one
    within a path). Columns that a table lacks are null. If none exists, the fallback's table, likewise; else an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)
    found = [p for p in paths if there(p)] or ([fallback] if fallback and there(fallback) else [])
    if not found:
        raise FileNotFoundError(", ".join([*paths, *([fallback] if fallback else [])]))
    out = None
    for n, p in enumerate(found):
        part = spark.read.parquet(p).withColumn("_from", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    names = [c for c in out.columns if c != "_from"]
    first = out.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*names), "_from").alias("_r"))
    return first.select(*[F.col("_r").getField(c).alias(c) for c in names])


def load_rules(rules: DataFrame, order: str, retired: tuple[str, ...] = (), key: str = "taxonomy_id", texts: tuple[str, ...] = ("requirement", "checkable_test")) -> DataFrame:
    """Rules without the retired ids; of an id that stands twice the first row by order, whole; texts with white space squeezed."""
    live = rules.where(F.col(key).isNotNull() & ~F.col(key).isin(*retired)) if retired else rules.where(F.col(key).isNotNull())
    first = live.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rules.columns), order).alias("_r"))
    return first.select(*[(T.display(F.col("_r").getField(c)) if c in texts else F.col("_r").getField(c)).alias(c) for c in rules.columns])


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """df, if no key stands twice; else an error that names one."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} isn't unique, for instance {twice[0][0]!r}")
    return df


def first_existing(spark: SparkSession, *paths: str, reader: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Reads the first path that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return (reader or spark.read.parquet)(p)
    raise FileNotFoundError(", ".join(paths))


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".pdf", ".docx", ".html", ".txt")) -> DataFrame:
    """(path, owner, name, length, modificationTime) of files below root with one of the suffixes, in any case; owner is the
    folder directly below root. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    ends = "|".join(s.lstrip(".") for s in suffixes)
    rest = F.regexp_extract("path", r".*?" + root.rstrip("/").split("/")[-1] + r"/(.*)$", 1)
    return df.where(F.lower("path").rlike(rf"\.({ends})$")).select("path", F.regexp_extract(rest, r"^([^/]+)/", 1).alias("owner"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def plain_pages(name: str, content: bytes) -> Iterator[tuple[int, str, str, str | None]]:
    """The built-in extractor: form feeds divide the pages of a text file; tags are dropped from HTML."""
    import html
    import re

    text = content.decode("utf-8", "replace")
    if name.lower().endswith((".html", ".htm")):
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
        text = html.unescape(re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?i)</(p|div|li|tr|h\d)>|<br\s*/?>", "\n", text)))
    for n, page in enumerate(text.split("\f"), 1):
        yield n, page.strip(), "text", None if page.strip() else "No text extracted"


def docx_pages(name: str, content: bytes) -> Iterator[tuple[int, str, str, str | None]]:
    """A .docx file as one page: its paragraphs, then the rows of its tables with cells divided by ' | '."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = [text(p) for p in body.findall(f"{w}p")]
    for row in body.findall(f"{w}tbl/{w}tr"):
        out.append(" | ".join(t for t in map(text, row.findall(f"{w}tc")) if t))
    whole = "\n".join(t for t in out if t)
    yield 1, whole, "docx", None if whole else "No text extracted"


def pdf_pages(ocr: Callable[[bytes, int], str] | None = None, few: int = 30) -> Callable:
    """An extractor for PDF files by whichever PDF library the workers have. Pages with fewer than `few` characters go to ocr (if
    given), whose text is taken if it is the longer one."""

    def extract(name: str, content: bytes):
        try:
            import fitz

            texts = [p.get_text("text") for p in fitz.open(stream=content, filetype="pdf")]
        except ImportError:
            import io

            import pypdf

            texts = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
        for n, t in enumerate(texts, 1):
            t, method = t.strip(), "pdf"
            if len(t) < few and ocr:
                seen = ocr(content, n).strip()
                if len(seen) > len(t):
                    t, method = seen, "pdf+ocr"
            yield n, t, method, None if len(t) >= few else "Low embedded-text count; inspect page" if t else "No text extracted"

    return extract


def by_suffix(**extractors: Callable) -> Callable:
    """One extractor out of several, chosen by the file's suffix; others are read as plain text or HTML."""

    def extract(name: str, content: bytes):
        return extractors.get(name.rsplit(".", 1)[-1].lower(), plain_pages)(name, content)

    return extract


def pages(files: DataFrame, extract: Callable = plain_pages, few: int = 30) -> DataFrame:
    """binaryFile rows (path, content) -> pages. extract(name, bytes) yields (page_number, text, method, warning); a file that
    fails gives one page without text and the error as its warning, so that one bad file doesn't end the run."""

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                name, digest = path.rsplit("/", 1)[-1], hashlib.sha256(content).hexdigest()
                try:
                    got = list(extract(name, bytes(content)))
                except Exception as e:
                    got = [(1, "", "failed", f"{type(e).__name__}: {e}"[:500])]
                rows += [(name, n, t, m, len(t), len(t) < few, w, digest) for n, t, m, w in got]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in PAGE_SCHEMA.split(",")])

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)
