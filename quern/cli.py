"""Command line: index, ci-index, enrich, worker, eval and analyze.

python -m quern.cli index --root SRC --store DIR [--force] [--dry-run]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quern.operators import evals
from quern.plans.engine import Engine, report
from quern.sources import files, sinks

RESULT = "query_id string, tags array<string>, recall_main double, recall_wide double, mrr double, ndcg double, top1 boolean, is_negative boolean, false_positive boolean"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if an evaluation has a query that found nothing."""
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("command", choices=["index", "ci-index", "enrich", "worker", "eval", "analyze"])
    for name in ("root", "store", "queries", "out", "date", "baseline"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--once", action="store_true", help="end the worker when the jobs that are there are done")
    known, rest = p.parse_known_args(args)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    engine = Engine(spark, known.store) if known.store else None
    if known.command == "index":
        print(engine.reindex(known.root, dry_run=known.dry_run, force=known.force))
    elif known.command == "ci-index":
        engine.ci_index(known.root, files.change_set(spark, rest))
    elif known.command == "enrich":
        print(engine.enrich())
    elif known.command == "worker":
        engine.work(once=known.once)
    elif known.command == "eval":
        rows = engine.evaluate(files.query_set(spark, known.queries)).cache()
        sinks.write_results(rows, known.out, known.date)
        print(report(rows))
        return int(rows.where("not is_negative and recall_main = 0").count() > 0)
    else:
        rows = files.results(spark, known.out, RESULT, latest=False)
        print(report(rows))
        if known.baseline:
            evals.baseline_delta(evals.summarise(rows), evals.summarise(files.results(spark, known.baseline, RESULT, latest=False))).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
