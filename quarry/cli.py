"""Command line: build an index, show its state, ask it.

    python -m quarry.cli build [ROOT...] --index FOLDER [--config FILE] [--env FILE] [--limit N] [--force] [--skip-ingest] [--skip-embed] [--quiet]
    python -m quarry.cli stats (--index FOLDER | --tables FOLDER)
    python -m quarry.cli query TEXT --index FOLDER [--config FILE] [--env FILE] [--top-k N] [--stage S] [--formats F...] [--full]
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config, load, load_env
from quarry.functions import text as X
from quarry.operators import embed, search, store
from quarry.plans import ingest
from quarry.runtime import ship, table
from quarry.sources import listing

EMPTY = {
    "documents": "doc_key string, path string, rel_path string, file_name string, format string, stage string, size_bytes long, mtime double, content_sha string, status string, error string, n_chunks int",
    "chunks": "chunk_id string, doc_id string, ord int, text string, headings array<string>, page_no int, n_chars int",
    "cache": "model_id string, hash string, dim int, vec array<float>",
}


class Index:
    """The tables of an index under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.tables = {name: store.Snapshots(spark, f"{folder}/{name}") for name in ("documents", "chunks", "vectors", "cache")}

    def read(self, name: str) -> DataFrame:
        if name in EMPTY and self.tables[name].current() is None:
            return self.spark.createDataFrame([], EMPTY[name])
        return self.tables[name].read()


def stats(documents: DataFrame, chunks: DataFrame, show: int = 40) -> dict:
    """Counts, formats by chunks, and the first failures by path."""
    out = store.status_counts(documents, chunks).first().asDict()
    out["by_format"] = [r.asDict() for r in store.stats_by_format(documents, chunks).orderBy(F.desc("chunks"), "format").collect()]
    out["failures"] = [r.asDict() for r in store.failures(documents).orderBy("rel_path").limit(show).collect()]
    return out


def build(index: Index, config: Config, args: argparse.Namespace) -> int:
    began = time.time()
    if not args.skip_ingest:
        files = listing.limited(listing.walk(index.spark, args.roots, list(config.exclude_dirs)), args.limit)
        got = ingest.run(files, index.read("documents"), config, args.force)
        index.tables["documents"].commit(store.upsert(index.read("documents"), got.documents, "doc_key"))
        index.tables["chunks"].commit(store.replace_chunks(index.read("chunks"), got.chunks))
        if not args.quiet:
            print(json.dumps({r.outcome: r.documents for r in got.counters.collect()} | {"elapsed_s": round(time.time() - began, 1)}))
    chunks = index.read("chunks")
    if not chunks.take(1):
        print("the index has no chunks", file=sys.stderr)
        return 1
    if not args.skip_embed:
        texts = chunks.select("chunk_id", X.prefixed(config.passage_prefix, F.col("text")).alias("text"))
        vectors, new = embed.embed_cached(texts, index.read("cache"), config.model_id, dimensions=config.dimensions)
        index.tables["vectors"].commit(vectors.select("chunk_id", F.col("hash").alias("text_hash"), "embedding"))
        index.tables["cache"].append(new)
    return 0


def ask(index: Index, config: Config, args: argparse.Namespace) -> int:
    documents, chunks = index.read("documents"), index.read("chunks")
    queries = index.spark.createDataFrame([("q", args.text)], "query_id string, text string")
    hits = search.search(store.all_chunks(chunks, documents), index.read("vectors"), queries, config, args.top_k, args.stage, args.formats).orderBy("rank").collect()
    for h in hits:
        place = " > ".join(h.source.headings or []) + (f" p.{h.source.page_no}" if h.source.page_no else "")
        print(f"{h.rank}. {round(h.score, 5)} {h.source.file_name} [{h.source.stage}] {place}\n   {h.text if args.full else h.text[:400].replace(chr(10), ' ')}")
    return 0 if hits else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    what = parser.add_subparsers(dest="what", required=True)
    b = what.add_parser("build")
    b.add_argument("roots", nargs="*", help="folders; those of the configuration if none are given")
    b.add_argument("--index", required=True)
    b.add_argument("--limit", type=int, default=0)
    for flag in ("--force", "--skip-ingest", "--skip-embed", "--quiet"):
        b.add_argument(flag, action="store_true")
    s = what.add_parser("stats")
    s.add_argument("--index")
    s.add_argument("--tables")
    q = what.add_parser("query")
    q.add_argument("text")
    q.add_argument("--index", required=True)
    q.add_argument("--top-k", type=int, default=0)
    q.add_argument("--stage")
    q.add_argument("--formats", nargs="*")
    q.add_argument("--full", action="store_true")
    for each in (b, q):
        each.add_argument("--config", help="a YAML file over the defaults")
        each.add_argument("--env", help="a file of KEY=value lines; what the environment has stays")
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.getOrCreate())
    if args.what == "stats":
        docs, chunks = (table(spark, args.tables, n) for n in ("documents", "chunks")) if args.tables else (Index(spark, args.index).read(n) for n in ("documents", "chunks"))
        print(json.dumps(stats(docs, chunks), ensure_ascii=False, indent=1))
        return 0
    index = Index(spark, args.index)
    if args.env:
        load_env(args.env)
    config = load(args.config) if args.config else Config()
    if args.what == "query":
        return ask(index, config, args)
    args.roots = args.roots or [str(r) for r in config.resolved_roots()]
    return build(index, config, args)


if __name__ == "__main__":
    sys.exit(main())
