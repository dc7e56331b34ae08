"""Segmentation: pages to lines, blocks, clauses; fragments stitched; batches and global numbers.

Order is explicit: every operator takes the columns that order its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import signals as S
from lexweave.session import materialize


def lines(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row for each line of a page, numbered from 0; null texts have none."""
    return pages.select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\r|\n", -1)).alias("line_no", "line"))


def repeated_lines(pages: DataFrame, doc: str = "doc", page: str = "page_number", text: str = "text", share: float = L.REPEATED_SHARE) -> DataFrame:
    """(doc, line_key, n_pages): lines that recur on at least max(3, share of the pages) pages of documents with 3 pages or more.

    Bullets and lines over 140 characters don't count; a line counts once for a page. Documents are joined to their page count,
    never gathered.
    """
    pages = pages.select(doc, page, text).distinct()
    n = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= L.REPEATED_MIN_PAGES)
    at = computed_once(lines(pages, doc, page, text=text), flat=T.line(F.col("line"))).withColumn("line_key", F.lower("flat"))
    at = at.where((F.col("flat") != "") & (F.length("flat") <= L.REPEATED_MAX_CHARS) & ~F.col("flat").rlike(L.BULLET))
    seen = at.select(doc, page, "line_key").distinct().groupBy(doc, "line_key").agg(F.count("*").alias("n_pages"))
    enough = F.greatest(F.lit(L.REPEATED_MIN_PAGES), F.floor(F.col("pages") * share).cast("int"))
    return seen.join(n, doc).where(F.col("n_pages") >= enough).select(doc, "line_key", "n_pages")


def without_repeated(pages: DataFrame, repeated: DataFrame, doc: str = "doc", page: str = "page_number", text: str = "text") -> DataFrame:
    """(doc, page, clean_text): each page without its document's repeated lines, normalised; a page's lines are put together per page."""
    once = pages.groupBy(doc, page).agg(F.min(text).alias(text))
    at = computed_once(lines(once, doc, page, text=text), line_key=F.lower(T.line(F.col("line"))))
    kept = at.join(repeated.select(doc, "line_key"), [doc, "line_key"], "left_anti")
    rows = kept.groupBy(doc, page).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    return once.select(doc, page).join(rows, [doc, page], "left").select(doc, page, T.normalize(F.coalesce(joined, F.lit(""))).alias("clean_text"))


def blocks(pages: DataFrame, *keys: str, text: str = "clean_text", longest: int = 140, letters: int = 100) -> DataFrame:
    """(keys, block_no, block): a blank line ends a block, a list item or a heading starts one. Worked out page by page."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    at = computed_once(lines(pages, *keys, text=text), flat=T.display(F.col("line")))
    blank = F.col("flat") == ""
    starts = F.col("flat").rlike(L.BULLET) | S.flat_heading(F.col("flat"), longest, letters) | F.coalesce(F.lag("blank").over(w), F.lit(True))
    at = at.withColumn("blank", blank).withColumn("starts", F.when(~F.col("blank") & starts, 1).otherwise(0))
    at = at.where(~F.col("blank")).withColumn("n", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = at.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("line_no", "flat"))).alias("r"))
    return rows.select(*keys, (F.col("n") - 1).cast("int").alias("block_no"), T.normalize(F.array_join(F.transform("r", lambda x: x["flat"]), "\n")).alias("block"))


def subclauses(c: Column) -> Column:
    """Parts of a text with two or more (x) markers, cut after ; or . before a lettered marker; else the text alone."""
    cut = F.regexp_replace(c, r"(?i)([;.])\s+(?:and\s+)?(\([a-z]{1,3}\)[\s“‘\"'])", "$1\u0001$2")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), T.line), lambda x: x != "")
    return F.when((F.regexp_count(c, F.lit("(?i)" + L.SUBCLAUSE)) >= 2) & (F.size(parts) > 1), parts).otherwise(F.array(c))


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(T.line(c), r"([.!?])\s+([A-Z0-9(\[])", "$1\u0001$2"), "\u0001"), lambda x: x != "")


def _pack(parts: Column, limit: int) -> Column:
    """Joins parts with spaces, greedily, while the result stays within the limit; a longer part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, s):
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > limit)
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full | (acc["cur"] == ""), s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def split_long(c: Column, limit: int = L.MAX_CHARS, by_subclause: bool = False) -> Column:
    """Pieces of a text over the limit at sentence (and, first, sub-clause) boundaries; without a boundary it stays whole."""
    flat = T.line(c)
    one = lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(_pack(sentences(x), limit))
    pieces = F.flatten(F.transform(subclauses(flat), one)) if by_subclause else one(flat)
    return F.when(F.length(flat) <= limit, F.array(flat)).otherwise(pieces)


def carry_heading(blocks: DataFrame, doc: str, *order: str, text: str = "block", longest: int = 140, letters: int = 100) -> DataFrame:
    """Adds is_heading and section_heading: the last heading before the block in its document, across pages."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = computed_once(blocks, _flat=T.display(F.col(text)))
    b = computed_once(b, is_heading=S.flat_heading(F.col("_flat"), longest, letters))
    return b.withColumn("section_heading", F.last(F.when(F.col("is_heading"), F.col("_flat")), ignorenulls=True).over(w)).drop("_flat")


def build_clauses(pages: DataFrame, doc: str = "doc", page: str = "page_number", text: str = "text", limit: int = L.MAX_CHARS, by_subclause: bool = False) -> DataFrame:
    """(doc, page, section_heading, clause_index, clause_text, tiny): pages to clauses; junk blocks and headings give no clause.

    clause_index counts within the document. Empty blocks vanish; blocks under 10 characters stay and are marked tiny.
    """
    clean = without_repeated(pages, repeated_lines(pages, doc, page, text), doc, page, text)
    b = carry_heading(blocks(clean, doc, page), doc, page, "block_no")
    kept = b.where(~F.col("is_heading") & ~S.junk(F.col("block")))
    p = kept.select(doc, page, "block_no", "section_heading", F.posexplode(split_long(F.col("block"), limit, by_subclause)).alias("piece_no", "clause_text"))
    w = Window.partitionBy(doc).orderBy(page, "block_no", "piece_no")
    return p.select(doc, page, "section_heading", F.row_number().over(w).alias("clause_index"), "clause_text", (F.length("clause_text") < L.MIN_REVIEWABLE).alias("tiny"))


def review_blocks(pages: DataFrame, doc: str = "doc", page: str = "page_number", text: str = "text") -> DataFrame:
    """(doc, page, block_no, review_text, reason): the side output of build_clauses()."""
    clean = without_repeated(pages, repeated_lines(pages, doc, page, text), doc, page, text)
    b = computed_once(blocks(clean, doc, page), flat=T.display(F.col("block")))
    reason = F.when(S.flat_junk(F.col("flat")), "navigation").when(~S.flat_heading(F.col("flat")) & (F.length("flat") < L.MIN_REVIEWABLE), "very short")
    return b.select(doc, page, "block_no", F.left(F.col("flat"), F.lit(2000)).alias("review_text"), reason.alias("reason")).where("reason is not null")


def stitch(df: DataFrame, doc: str, *order: str, text: str = "clause_text") -> DataFrame:
    """A row that ends in ':' absorbs the next row of its document; an absorbed row absorbs nothing.

    In a run of rows that end in ':' every odd one is a head, so the parity of the place in the run decides. Adds `stitched`.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    t = T.display(F.col(text))
    x = df.withColumn("_t", t).withColumn("_c", F.col("_t").endswith(":")).withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("_t").over(w))
    so_far = Window.partitionBy(doc).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_last", F.coalesce(F.max(F.when(~F.col("_c"), F.col("_n"))).over(so_far), F.lit(0)))
    x = x.withColumn("_head", F.col("_c") & ((F.col("_n") - F.col("_last")) % 2 == 1) & F.col("_next").isNotNull())
    x = x.withColumn("_gone", F.coalesce(F.lag("_head").over(w), F.lit(False))).where("not _gone")
    merged = F.when(F.col("_head"), F.concat("_t", F.lit(" "), "_next")).otherwise(F.col(text))
    return x.withColumn(text, merged).withColumn("stitched", F.col("_head")).drop("_t", "_c", "_n", "_next", "_last", "_head", "_gone")


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds a gap-free number from 1 in the global order, without a single-partition window.

    Rows are range-partitioned and sorted; each partition's rows are counted (a driver-side list as long as the number of
    partitions), and a row's number is its place in the partition plus the rows before. The order must be total.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "numbered"
    )
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("__part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(parts), "__part").withColumn(name, F.col("__before") + F.col("__row") - F.col("__first") + 1).drop("__part", "__row", "__first", "__before")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds batch_no (from 0): fixed-size batches over the global order."""
    return numbered(df, *order, name="_pos").withColumn("batch_no", F.floor((F.col("_pos") - 1) / size).cast("bigint")).drop("_pos")
