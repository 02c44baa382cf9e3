"""Command line: python -m lodestar.cli {encode, search, audit, eval, report-save}."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.functions.encoders import load_encoder
from lodestar.functions.judges import make_judges, rare, sud
from lodestar.plans.retriever import GeoIndex, Retriever
from lodestar.sources import tables


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lodestar").getOrCreate()


def encode(spark: SparkSession, args) -> int:
    rows = load_encoder(args.model).encode(tables.in_memory(spark, args.texts))
    if args.output:
        shape = tables.save_vectors(rows.select("doc_id", "embedding"), args.output)
    else:
        found = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        shape = (found[0], found[1])
    print(f"Embeddings shape: {shape}")
    if args.output:
        print(f"Saved to {args.output}")
    return 0


def search(spark: SparkSession, args) -> int:
    corpus = tables.corpus(spark, args.corpus)
    found = Retriever(spark, args.model).index(corpus, args.k).search(args.query, args.top)
    texts = {r["doc_id"]: r["text"] for r in corpus.where(F.col("doc_id").isin(found)).collect()} if found else {}  # as many as asked for
    print(json.dumps({"query": args.query, "results": [texts[i] for i in found]}, ensure_ascii=False, indent=2))
    return 0


def _index(spark: SparkSession, args) -> GeoIndex:
    return GeoIndex.build(load_encoder(args.model), tables.text_lines(spark, args.corpus_file, strict=True), args.k)


def audit(spark: SparkSession, args) -> int:
    print(f"Edges with curvature computed: {_index(spark, args).audit().count()}")
    return 0


def evaluate(spark: SparkSession, args) -> int:
    metric = args.metric.lower()
    if metric not in ("rare", "sud"):
        print(f"Unsupported metric: {args.metric}", file=sys.stderr)
        return 1
    judges = make_judges(args.judges)
    rows = tables.eval_records(spark, args.queries_file).withColumn("id", F.monotonically_increasing_id())
    wanted = ("docs",) if metric == "rare" else ("gt_docs", "new_docs")
    for name in wanted:
        if rows.where(F.col(name).isNull()).take(1):
            raise KeyError(name)
    scores = rare(rows, judges, args.policy) if metric == "rare" else sud(rows, judges, args.policy)
    row = scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    print(json.dumps({"metric": metric.upper(), "mean": row["mean"], "n": row["n"]}, indent=2))
    return 0


def report_save(spark: SparkSession, args) -> int:
    print(f"Saved report to {_index(spark, args).save_report(args.name, args.outdir)}")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, f, *positional: str) -> argparse.ArgumentParser:
        sub = verbs.add_parser(name)
        sub.set_defaults(run=f)
        for p in positional:
            sub.add_argument(p)
        return sub

    sub = verb("encode", encode, "model")
    sub.add_argument("texts", nargs="+")
    sub.add_argument("-o", "--output", help="folder for the vectors")
    sub = verb("search", search, "model", "corpus")
    sub.add_argument("--k", type=int, default=30, help="neighbours in the graph")
    sub.add_argument("--query", required=True)
    sub.add_argument("--top", type=int, default=10)
    sub = verb("audit", audit, "model", "corpus_file")
    sub.add_argument("--k", type=int, default=30)
    sub = verb("eval", evaluate, "queries_file")
    sub.add_argument("--metric", default="rare", help="rare or sud")
    sub.add_argument("--judges", default="mock", help="names, separated by commas")
    sub.add_argument("--policy", default="mean", help="mean, majority, max or min")
    sub = verb("report-save", report_save, "model", "corpus_file")
    sub.add_argument("--k", type=int, default=30)
    sub.add_argument("--name", required=True)
    sub.add_argument("--outdir", default=".")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(_session(), args)


if __name__ == "__main__":
    sys.exit(main())
