"""The queries of the llm subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions.keys import name_key
from lexweave.llm import boilerplate, chunking, copies, leakage, neardup, ocr, overlap, packing, reading, splits
from lexweave.llm.sql import LINES_MIN_SHARE, SQL
from lexweave.session import delete_later, materialize, shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _across(spark, d):
    return overlap.CrossSplit(_t(spark, d, "policy_clauses"), _t(spark, d, "split_assignments"))


def p1_found(spark, d):
    return _across(spark, d).pairs().select(F.col("id_a").alias("clause_id_a"), F.col("id_b").alias("clause_id_b"))


def p1_overlaps(spark, d):
    return _across(spark, d).records().select(F.col("id").alias("clause_id"), "split", "n_links", F.round("overlap", 6).alias("overlap"))


def p1_chunk_overlaps(spark, d):
    return _across(spark, d).records().select(F.col("id").alias("clause_id"), "split", F.round("chunk_overlap", 6).alias("chunk_overlap"))


def p1_report(spark, d):
    return overlap.report(_t(spark, d, "policy_clauses"), _t(spark, d, "split_assignments"))


def _ledger(spark, d):
    clauses = _t(spark, d, "policy_clauses").select("clause_id", "app_name", "clause_text", "ingested_at")
    folder = f"{shared_dir(spark)}/lexweave-ledger-{uuid.uuid4().hex}"
    delete_later(spark, folder)
    ledger = copies.CopyLedger(spark, folder, buckets=16)
    for batch in copies.batches_by_time(clauses, "ingested_at"):
        ledger.update(copies.keyed(batch, "clause_text", "app_name", "clause_id", ledger.buckets))
    return ledger


def p2_found(spark, d):
    return copies.copy_pairs(_ledger(spark, d)).select(F.col("keep_id").alias("keep_clause_id"), F.col("id").alias("clause_id"))


def p2_copy_counts(spark, d):
    return _ledger(spark, d).counts().select(F.col("keep_id").alias("keep_clause_id"), "n_copies")


def p3_found(spark, d):
    pairs = splits.related_pairs(_t(spark, d, "policy_clauses"), "app_name", "source_document")
    return pairs.select(F.col("owner_a").alias("app_a"), F.col("owner_b").alias("app_b"))


def p3_splits(spark, d):
    out = splits.assign(_t(spark, d, "policy_clauses"), "clause_id", "app_name", "source_document")
    return out.select(F.col("id").alias("clause_id"), "group_id", "split")


def _repeated(spark, d):
    return boilerplate.repeated_lines(_t(spark, d, "raw_clauses"), _t(spark, d, "pages_in"))


def p3_checks(spark, d):
    """One row: how many ids were placed, how many owners and documents stand in more than one split, whether the shares are near their
    targets (as near as the largest group allows)."""
    c = _t(spark, d, "policy_clauses").select("clause_id", name_key(F.col("app_name")).alias("app"), name_key(F.col("source_document")).alias("document")).distinct()
    placed = materialize(p3_splits(spark, d), "placed")
    x = placed.join(c, "clause_id")
    torn = lambda k: x.where(f"{k} <> ''").groupBy(k).agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias(f"torn_{k}s"))
    largest = placed.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    n = placed.agg(F.count("*").alias("n_ids"), *[F.sum((F.col("split") == s).cast("int")).alias(s) for s in splits.TARGETS])
    near = [F.abs(F.col(s) - share * F.col("n_ids")) <= F.greatest(F.col("largest"), F.lit(1)) for s, share in splits.TARGETS.items()]
    one = n.crossJoin(largest).crossJoin(torn("app")).crossJoin(torn("document"))  # one row each
    return one.select("n_ids", "torn_apps", "torn_documents", (near[0] & near[1] & near[2]).alias("near_targets"))


def p4_found(spark, d):
    return _repeated(spark, d).select(F.col("id").alias("clause_id"), "line_no")


def p4_by_share(spark, d):
    out = boilerplate.repeated_lines(_t(spark, d, "raw_clauses"), _t(spark, d, "pages_in"), boilerplate.LINES_MIN_DOCS, LINES_MIN_SHARE)
    return out.select(F.col("id").alias("clause_id"), "line_no")


def p4_clean_blocks(spark, d):
    out = boilerplate.without_lines(_t(spark, d, "raw_clauses"), _repeated(spark, d))
    return out.select(F.col("id").alias("clause_id"), "clean_text", "n_removed")


def p5_found(spark, d):
    at = chunking.boundary_rows(_t(spark, d, "policy_clauses"), "clause_id", "clause_text")
    return at.select(F.col("id").alias("clause_id"), "boundary_at").distinct()


def p5_pieces(spark, d):
    out = chunking.pieces(_t(spark, d, "policy_clauses"), "clause_id", "clause_text", "section_heading")
    return out.withColumnsRenamed({"id": "clause_id", "heading": "section_heading", "piece": "piece_text"})


def p5_checks(spark, d):
    """Each divided clause with what must hold of its pieces: in order, within the limit, over the whole text, overlapping as allowed."""
    w = Window.partitionBy("clause_id").orderBy("piece_no")
    p = p5_pieces(spark, d).withColumn("before", F.lag("end_at").over(w))
    texts = _t(spark, d, "policy_clauses").groupBy("clause_id").agg(F.min("clause_text").alias("text"))
    own = F.expr("substring(text, start_at + 1, end_at - start_at) = piece_text")
    joins = F.coalesce((F.col("start_at") <= F.col("before")) & (F.col("start_at") >= F.col("before") - chunking.OVERLAP) & (F.col("end_at") > F.col("before")), F.col("start_at") == 0)
    return p.join(texts, "clause_id").groupBy("clause_id").agg(
        (F.max(F.length("piece_text")) <= chunking.LIMIT).alias("within_limit"),
        F.every(own).alias("same_text"),
        (F.every(joins) & (F.max("end_at") == F.max(F.length("text")))).alias("covered"),
        (F.count_distinct("piece_no") == F.max("piece_no") + 1).alias("in_order"),
    )


def p6_groups(spark, d):
    return neardup.groups(_t(spark, d, "policy_clauses"), "clause_id", "clause_text").withColumnRenamed("id", "clause_id")


def p6_found(spark, d):
    out = neardup.groups(_t(spark, d, "policy_clauses"), "clause_id", "clause_text").where("id <> group_id")
    return out.select(F.col("group_id").alias("group_clause_id"), F.col("id").alias("clause_id")).distinct()


def _repair(spark, d):
    return ocr.Repair(_t(spark, d, "raw_clauses"), _t(spark, d, "pages_in"))


def p7_found(spark, d):
    return _repair(spark, d).found()


def p7_paragraphs(spark, d):
    return _repair(spark, d).paragraphs()


def p8_pack(spark, d):
    return packing.containers(_t(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_usage(spark, d):
    return packing.usage(p8_pack(spark, d))


def p8_checks(spark, d):
    """One row: documents placed, documents placed wrongly, containers over the capacity, undivided texts that were divided, and whether
    the containers are at most one in a hundred (and one for each group) above the least possible number."""
    placed = materialize(p8_pack(spark, d), "placed")
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    bad = (F.col("pieces") != F.col("last") + 1) | (F.col("n") != F.col("end"))
    cut = (F.col("n") <= packing.CAPACITY) & (F.col("pieces") > 1)
    of_docs = docs.agg(F.count("*").alias("n_docs"), F.sum(bad.cast("int")).alias("n_misplaced"), F.sum(cut.cast("int")).alias("n_cut"), F.sum("n").alias("tokens"))
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    of_bins = per.agg(F.count("*").alias("bins"), F.sum((F.col("n") > packing.CAPACITY).cast("int")).alias("n_overfull"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    one = of_docs.crossJoin(of_bins)  # one row each
    return one.select("n_docs", "n_misplaced", "n_cut", "n_overfull", (F.col("bins") <= 1.01 * least + F.ceil(F.col("n_docs") / packing.GROUP)).alias("near_bound"))


def p9_leaks(spark, d):
    return leakage.matches(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_found(spark, d):
    return p9_leaks(spark, d).where("edits = 0").select("item_id", "doc_id")


def p9_runs(spark, d):
    return p9_leaks(spark, d).where("edits = 0").select("item_id", "doc_id", "run_words")


def _levels(spark, d):
    return reading.score(_t(spark, d, "documents"), reading.train(_t(spark, d, "reading_samples")))


def p10_found(spark, d):
    return _levels(spark, d).select("doc_id", "level_no").distinct()


def p10_profile(spark, d):
    source = _t(spark, d, "documents").select("doc_id", "source")
    out = _levels(spark, d).join(source, "doc_id").groupBy("source", "level_no")
    return out.agg(F.count("*").alias("n_docs"), F.round(F.avg("difficulty"), 3).alias("difficulty"))


QUERIES = {
    "p1_found": p1_found,
    "p1_overlaps": p1_overlaps,
    "p1_chunk_overlaps": p1_chunk_overlaps,
    "p1_report": p1_report,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_checks": p5_checks,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p2_found": p2_found,
    "p2_copy_counts": p2_copy_counts,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_checks": p3_checks,
    "p4_found": p4_found,
    "p4_by_share": p4_by_share,
    "p4_clean_blocks": p4_clean_blocks,
    "p7_found": p7_found,
    "p7_paragraphs": p7_paragraphs,
    "p8_pack": p8_pack,
    "p8_usage": p8_usage,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_runs": p9_runs,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}
__all__ = ["QUERIES", "SQL"]
