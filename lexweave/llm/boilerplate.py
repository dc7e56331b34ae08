"""Problem 4: lines repeated across one source's documents.

Lines are normalised and hashed, (source, hash, document) is made distinct before anything is counted, lines whose
document count reaches the threshold are kept as a table of their own, and each text is rebuilt without its frequent lines.
Where one line of one source makes up a large share of all lines, the join with that table is split by adaptive execution.

A line is frequent when it stands in at least ``min_docs`` documents of its source and, if ``min_share`` is given, in at
least that share of the source's documents. Rows with a null source take part in nothing and keep their text; null and
empty texts come out unchanged; lines without a-z0-9 are never removed. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import computed_once, name_key, reject_missing
from lexweave.session import materialize

LINES_MIN_DOCS = 8


def line_key(line: Column) -> Column:
    """Lower case, each run of digits as one 0, only a-z0-9."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[^a-z0-9]+", "")


def lines_of(df: DataFrame, id_col: str, source: str, document: str, text: str) -> DataFrame:
    """(id, source_key, document, line_no, line_hash) for non-empty keys."""
    lines = df.where(F.col(source).isNotNull()).select(
        F.col(id_col).alias("id"),
        name_key(F.col(source)).alias("source_key"),
        F.col(document).alias("document"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"),
    )
    keyed = computed_once(lines, line_key=line_key(F.col("line"))).where("line_key <> ''")
    return keyed.select("id", "source_key", "document", "line_no", F.unhex(F.md5("line_key")).alias("line_hash"))


def frequent_lines(lines: DataFrame, min_docs: int, min_share: float = 0.0) -> DataFrame:
    """(source_key, line_hash, n_docs)."""
    once = lines.where("document is not null").select("source_key", "line_hash", "document").distinct()
    out = once.groupBy("source_key", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    if min_share > 0:
        docs = lines.where("document is not null").select("source_key", "document").distinct().groupBy("source_key").agg(F.count("*").alias("all_docs"))
        out = out.join(docs, "source_key").where(F.col("n_docs") >= min_share * F.col("all_docs")).drop("all_docs")
    return out


def not_scanned(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks whose page is not marked needs_ocr; a page counts as scanned if any of its rows says so."""
    reject_missing(blocks, "source_file", "page_start")
    reject_missing(pages, "doc", "page_number", "needs_ocr")
    scanned = (
        pages.where("needs_ocr").select(F.col("doc").alias("source_file"), F.col("page_number").alias("page_start")).distinct()
    )
    return blocks.join(scanned, ["source_file", "page_start"], "left_anti")


def repeated_lines(blocks: DataFrame, pages: DataFrame, min_docs: int = LINES_MIN_DOCS, min_share: float = 0.0) -> DataFrame:
    """(id, line_no): the lines to remove."""
    lines = lines_of(not_scanned(blocks, pages), "clause_id", "app_name", "source_file", "clause_text")
    # written out, for against an aggregate the join below couldn't be split where a notice stands in every document of a large site
    often = materialize(frequent_lines(lines, min_docs, min_share).select("source_key", "line_hash"), "often")
    return lines.join(often, ["source_key", "line_hash"]).select("id", "line_no").distinct()


def without_lines(blocks: DataFrame, remove: DataFrame) -> DataFrame:
    """(id, clean_text, n_removed): every distinct id once, its text rebuilt without the lines of remove(id, line_no).

    The line numbers of one text are gathered beside that text, so a row never grows beyond its own text.
    """
    gone = remove.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    texts = blocks.groupBy(F.col("clause_id").alias("id")).agg(F.min("clause_text").alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    return texts.join(gone, "id", "left").select(
        "id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
