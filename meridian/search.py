"""Searches from the command line, as a Spark application.

    spark-submit --py-files meridian.zip meridian/search.py build base.fvecs /data/index --degree 16
    python -m meridian.search search /data/index queries.fvecs --truth truth.ivecs --topk 10 --ef 50 --repeat 4

``search`` prints a line of figures as JSON: queries, seconds, queries a second
and, with a truth, recall and hits. Files are those of meridian.sources.vectors,
told by their endings. With repeat, queries are asked again under new ids and
held against the truth of their first round.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.errors import MeridianError
from meridian.index import EARLY_EXIT, VectorIndex
from meridian.operators import evaluate, knn
from meridian.scratch import cut
from meridian.shipping import ship
from meridian.sources.vectors import read_truth, read_vectors, write_results


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meridian.search", description="Build and search vector indexes.")
    jobs = top.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("build", help="an index of a file of vectors")
    build.add_argument("vectors")
    build.add_argument("index")
    build.add_argument("--dtype", help="element type, where the file's ending doesn't tell it")
    build.add_argument("--degree", type=int, default=16)
    build.add_argument("--refine", action="store_true", help="neighbours of neighbours as well")
    search = jobs.add_parser("search", help="the nearest of each query")
    search.add_argument("index")
    search.add_argument("queries")
    search.add_argument("--dtype", help="element type of the queries, where the file's ending doesn't tell it")
    search.add_argument("--topk", type=int, default=10)
    search.add_argument("--ef", type=int, default=50)
    search.add_argument("--width", type=int, default=8, help="nodes that a query expands in a round")
    search.add_argument("--repeat", type=int, default=1, help="how often all queries are asked")
    search.add_argument("--early-exit", choices=EARLY_EXIT, default="none")
    search.add_argument("--exact", action="store_true", help="scan all vectors of the index")
    search.add_argument("--truth", help="true neighbours; recall is printed")
    search.add_argument("--recall-csv", help="new folder for the recall of each query")
    search.add_argument("--result-prefix", help="write PREFIX_ids.bin and PREFIX_distances.bin")
    return top


def vectors_of(spark: SparkSession, path: str, dtype: str | None) -> DataFrame:
    return read_vectors(spark, path, dtype=dtype) if dtype else read_vectors(spark, path)


def found(spark: SparkSession, args: argparse.Namespace, queries: DataFrame) -> DataFrame:
    index = VectorIndex.load(spark, args.index)
    wrong = queries.where(F.size(knn.QUERY_VECTOR) != index.meta["dims"]).limit(1).count()
    if wrong:
        raise MeridianError(f"queries must have {index.meta['dims']} dimensions")
    if args.exact:
        return knn.knn(queries, index.vectors(), args.topk)
    return index.search(queries, args.topk, ef_search=args.ef, early_exit_policy=args.early_exit, width=args.width)


def run_search(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The figures; results are written once and read for each use."""
    if args.repeat < 1 or args.topk < 1:
        raise MeridianError("repeat and topk must be positive")
    if args.recall_csv and not args.truth:
        raise MeridianError("recall by query needs a truth")
    ship(spark)
    once = vectors_of(spark, args.queries, args.dtype)
    asked = once.count() * args.repeat
    if not asked:
        raise MeridianError("there are no queries")
    began = time.perf_counter()
    rows = cut(found(spark, args, knn.as_queries(once, args.repeat)), "found")
    seconds = time.perf_counter() - began
    figures = {"queries": asked, "seconds": round(seconds, 3), "qps": round(asked / seconds, 3)}
    if args.truth:
        truth = read_truth(spark, args.truth)
        deepest, known = truth.agg(F.max("rank"), F.max(knn.QUERY) + 1).first()
        if (deepest or 0) < args.topk:
            raise MeridianError(f"the truth has {deepest or 0} neighbours a query, not {args.topk}")
        each = evaluate.recall_by_query(rows, truth, args.topk, known)
        hits = each.agg(F.sum("hits")).first()[0] or 0
        figures |= {"hits": hits, "recall": round(hits / (asked * args.topk), 6)}
        if args.recall_csv:
            each.write.option("header", True).csv(args.recall_csv)
    if args.result_prefix:
        write_results(rows, args.result_prefix, args.topk)
    return figures


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meridian.search").getOrCreate()
    try:
        if args.job == "build":
            index = VectorIndex.build(vectors_of(spark, args.vectors, args.dtype), args.index, args.degree, args.refine)
            print(json.dumps({"index": index.path, "dims": index.meta["dims"], "degree": index.meta["degree"]}))
        else:
            print(json.dumps(run_search(spark, args)))
    except MeridianError as e:
        print(json.dumps({"error": str(e)}))
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
