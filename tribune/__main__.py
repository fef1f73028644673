"""python -m tribune JOB name=value ...: runs a job of tribune.plans.jobs. Jobs that need lemmas take model=PATH, as learn_lemmas writes it; without one, words are
their own lemmas."""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import SparkSession

from tribune.operators.analyzer import SimpleAnalyzer
from tribune.operators.lemmas import load_model
from tribune.plans import jobs
from tribune.sources import rest

JOBS = {n: f for n, f in vars(jobs).items() if inspect.isfunction(f) and not n.startswith("_") and f.__module__ == jobs.__name__ and n not in ("stored", "last_processed")}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in JOBS:
        print(__doc__, *(f"  {n}{inspect.signature(f)}" for n, f in JOBS.items()), sep="\n")
        return 2
    own = spark is None
    spark = spark or SparkSession.builder.appName(f"tribune {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options: dict = dict(a.split("=", 1) for a in args[1:])
    if "analyzer" in inspect.signature(JOBS[args[0]]).parameters:
        model = options.pop("model", None)
        options["analyzer"] = load_model(spark, model) if model else SimpleAnalyzer()
    if own:
        rest.register(spark)
    told = JOBS[args[0]](spark, **options)
    if told:
        print(*(f"{k}={v}" for k, v in told.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
