"""Headline timings: ``BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py`` prints one JSON line.

The inputs are written once before the clock starts, the derived tables so that
each figure is the operator itself, the documents as several files because the
given single row group can only be read by one task. Every query is run once to warm the JVM and then timed; results go to the ``noop`` sink, which
evaluates every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from graphask.examples import queries as q  # noqa: E402
from graphask.examples.star_schema import StarSchema  # noqa: E402
from graphask.plans.lineage import use_local_scratch  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INPUTS = ("questions", "gold_questions", "nodes", "edges", "dictionary", "samples", "vocabulary")
HEADLINE = (
    "txt_tokenize",
    "txt_tag_entities",
    "txt_analyze",
    "feat_binary_bow",
    "ml_naive_bayes_fit",
    "ml_predict",
    "graph_property_lookup",
    "graph_inbound_neighbors",
    "graph_neighbor_lists",
    "qa_batch",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("graphask-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_scratch(spark)
    return spark


def materialised(spark: SparkSession, folder: str) -> StarSchema:
    derived = StarSchema(spark, SF_DIR)
    star = StarSchema(spark, SF_DIR)
    for name in INPUTS:
        path = f"{folder}/{name}"
        writer = getattr(derived, name).write
        if name in ("nodes", "edges"):
            writer = writer.partitionBy("label" if name == "nodes" else "rel")
        writer.parquet(path)
        star.__dict__[name] = spark.read.parquet(path)
    documents = f"{folder}/documents.parquet"
    derived.table("documents").repartition(int(CPUS)).write.parquet(documents)
    given = star.table
    star.table = lambda name: spark.read.parquet(documents) if name == "documents" else given(name)
    return star


def evaluate(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    star = materialised(spark, tempfile.mkdtemp(prefix="graphask-bench-"))

    def prepare() -> None:
        for name in ("lexicon", "engine", "graph"):
            star.__dict__.pop(name, None)
        graph = star.engine.graph
        _ = graph.hot_names, graph.hot_targets, graph.hot_sources

    seconds: dict[str, float] = {}
    prepare()
    seconds["prepare_engine"] = timed(prepare)
    for name in HEADLINE:
        run = getattr(q, name)
        evaluate(run(star))
        seconds[name] = timed(lambda run=run: evaluate(run(star)))
    n_questions = star.questions.count()
    print(
        json.dumps({
            "metric": "total_seconds_headline_queries",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": {name: round(value, 3) for name, value in seconds.items()},
            "sf": Path(SF_DIR).name,
            "questions": n_questions,
            "questions_per_sec": round(n_questions / seconds["qa_batch"], 1),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
