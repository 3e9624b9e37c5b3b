"""Command line: build an index, search it, evaluate it.

    python -m quern.cli build COLLECTION.tsv INDEX [--sample K] [--compressed]
    python -m quern.cli search INDEX ["query text" ...] [--mode disjunctive] [--method bm25] [-k 10]
    python -m quern.cli evaluate INDEX QUERIES.tsv QRELS.txt

``search`` without a query asks for queries in a loop over the cached index until ``exit`` or the
end of the input.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.functions.scoring import METHODS
from quern.operators.compressed import CompressedIndex
from quern.operators.evaluate import evaluate_all_queries, mean_ndcg
from quern.operators.index import Index, build_index, build_sample_index
from quern.operators.search import MODES, search
from quern.sources.collection import read_collection, read_qrels, read_queries


def load(spark: SparkSession, path: str, compressed: bool) -> Index:
    return CompressedIndex.load(spark, path).plain() if compressed else Index.load(spark, path)


def answers(index: Index, spark: SparkSession, texts: list[str], mode: str, method: str, k: int) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return search(index, rows, mode, method, k).orderBy("query_id", "rank")


def choose(ask: Callable[[str], str], name: str, options: tuple[str, ...], last: str) -> str | None:
    """One of ``options`` by number or name, ``last`` for an empty line, None for anything else."""
    given = ask(f"{name} ({', '.join(f'{i} {o}' for i, o in enumerate(options, 1))}) [{last}]: ").strip().lower()
    if given.isdigit() and 1 <= int(given) <= len(options):
        return options[int(given) - 1]
    return last if not given else given if given in options else None


def converse(index: Index, spark: SparkSession, mode: str, method: str, k: int, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    """Query, mode and method from ``ask``, ranked documents to ``say``, until ``exit``."""
    try:
        while (text := ask("query (exit to leave): ").strip()).lower() != "exit":
            if not text:
                say("an empty query finds nothing")
                continue
            chosen = choose(ask, "mode", MODES, mode), choose(ask, "method", METHODS, method)
            if None in chosen:
                say("not one of the choices")
                continue
            mode, method = chosen
            began = time.time()
            rows = answers(index, spark, [text], mode, method, k).collect()  # at most k rows
            for r in rows:
                say(f"{r['rank']:3d}  document {r['doc_id']}  score {r['score']}")
            say(f"{len(rows) or 'no'} results in {time.time() - began:.2f} s")
    except EOFError:
        pass


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("collection")
    b.add_argument("index")
    b.add_argument("--partitions", type=int)
    b.add_argument("--sample", type=int, help="index so many sampled documents only")
    b.add_argument("--seed", type=int)
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query", nargs="*")
    s.add_argument("--mode", choices=MODES, default="conjunctive")
    s.add_argument("--method", choices=METHODS, default="tfidf")
    s.add_argument("-k", type=int, default=10)
    e = sub.add_parser("evaluate")
    for name in ("index", "queries", "qrels"):
        e.add_argument(name)
    for parser in (b, s, e):
        parser.add_argument("--compressed", action="store_true", help="postings stored as compressed blocks")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    began = time.time()
    if a.command == "build":
        docs = read_collection(spark, a.collection, a.partitions)
        built = build_index(docs) if a.sample is None else build_sample_index(docs, a.sample, a.seed)
        (CompressedIndex.of(built) if a.compressed else built).save(a.index)
    elif a.command == "search":
        index = load(spark, a.index, a.compressed)
        if not a.query:
            index = index.cache()
            converse(index, spark, a.mode, a.method, a.k)
            index.uncache()
            return
        answers(index, spark, a.query, a.mode, a.method, a.k).show(a.k * len(a.query), truncate=False)
    else:
        metrics = evaluate_all_queries(load(spark, a.index, a.compressed), read_queries(spark, a.queries), read_qrels(spark, a.qrels))
        mean_ndcg(metrics).show(truncate=False)
    print(f"{time.time() - began:.2f} s")


if __name__ == "__main__":
    main()
