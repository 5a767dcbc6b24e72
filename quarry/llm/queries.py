"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import budget, lookalike, neardup, packing, scans, sentences, split, tokens
from quarry.llm.overlap import longest_overlap
from quarry.runtime import saved, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "chunks"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alikes(table(spark, sf_dir, "chunks"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.with_same_form(table(spark, sf_dir, "chunks").select("chunk_id", "text", "headings"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, sf_dir, "chunks"))


def _totals(spark: SparkSession, sf_dir: str) -> budget.State:
    """The token state of the given tables, reached from that of an earlier store by what is new, changed and gone."""
    documents = table(spark, sf_dir, "documents")
    parts = saved(budget.own_parts(table(spark, sf_dir, "chunks"), longest_overlap(table(spark, sf_dir, "chunk_params"))))
    return budget.update_parts(parts, documents, budget.update_parts(*budget.earlier(parts, documents)))


def p3_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.slices(_totals(spark, sf_dir).cube)


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).snapshot.drop("h1", "h2", "n_parts")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scanned(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"), longest_overlap(table(spark, sf_dir, "chunk_params")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(_scans(spark, sf_dir))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(_scans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(*(table(spark, sf_dir, t) for t in ("chunks", "documents", "chunk_params"))).select("chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(*(table(spark, sf_dir, t) for t in ("chunks", "documents", "chunk_params")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits")
    tokenizers = sorted({r.tokenizer for r in limits.select("tokenizer").distinct().collect()})  # a table of a few rows
    return packing.pack(packing.sizes(table(spark, sf_dir, "documents"), tokenizers), limits)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(_packed(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(sentences.plain_documents(table(spark, sf_dir, "documents")))


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every document, whatever its format and status."""
    return sentences.sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_forms, p2_groups, p3_slices, p3_documents, p4_found, p4_paragraphs, p5_found, p5_pieces, p6_ids, p7_containers, p7_usage, p8_found, p8_units)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
            select distinct chunk_id from chunks c left join documents d on d.doc_key = c.doc_id
            left join chunk_params p on p.format = lower(trim(d.format))
            where length(c.text) > coalesce(p.max_chars, (select max_chars from chunk_params where format = 'default'))""",
    }
