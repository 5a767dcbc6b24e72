"""Extra columns whose names an operator uses itself change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.llm import budget, lookalike, neardup, packing, scans, sentences, split, tokens

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")
NAMES = "id id1 id2 name place own before after piece run first form stored row words word part kind shared anchor task blocks size bits near start container shard purpose capacity key good skeleton _name n p1 p2 h1 h2 own_no line line_no".split()


def crowded(df):
    return df.select("*", *(F.lit(f"{n}").alias(n) for n in NAMES if n not in df.columns))


def rows(df):
    return sorted(map(str, df.collect()))


CALLS = {
    "similar_pairs": lambda c, d, p, l: neardup.similar_pairs(c),
    "look_alikes": lambda c, d, p, l: lookalike.look_alikes(c),
    "look_alike_classes": lambda c, d, p, l: lookalike.look_alike_classes(c),
    "totals": lambda c, d, p, l: budget.update(c, d).cube,
    "scans": lambda c, d, p, l: scans.found(scans.scanned(c, d)),
    "paragraphs": lambda c, d, p, l: scans.paragraphs(scans.scanned(c, d)),
    "split": lambda c, d, p, l: split.split(c, d, p).drop("headings"),
    "oversized": lambda c, d, p, l: split.oversized(c, d, p),
    "ids": lambda c, d, p, l: tokens.encoded(d).select("doc_id", F.size("ids")),
    "pack": lambda c, d, p, l: packing.pack(crowded(packing.sizes(d, ["byte_bpe_50k"])) if "shard" in d.columns else packing.sizes(d, ["byte_bpe_50k"]), l).groupBy("purpose").agg(F.countDistinct("container"), F.sum("size")),
    "sentences": lambda c, d, p, l: sentences.sentences(sentences.plain_documents(d)),
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_clashing_columns(spark, name):
    tables = [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("chunks", "documents", "chunk_params", "size_limits")]
    assert rows(CALLS[name](*map(crowded, tables))) == rows(CALLS[name](*tables))
