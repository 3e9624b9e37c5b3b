"""Python workers give memory back at the end of a task, as they outlive it beside the executor's JVM."""

import os
import time

import pandas as pd
import pytest

from quern.llm import packing, queries


def anonymous_mb(spark) -> float:
    """Of the session's largest Python worker."""

    def report(batches):
        for _ in batches:
            time.sleep(0.5)  # so that every worker gets a task
            with open("/proc/self/status") as f:
                yield pd.DataFrame({"mb": [int(line.split()[1]) / 1024 for line in f if line.startswith("RssAnon")]})

    return spark.range(0, 4, 1, 4).mapInPandas(report, "mb double").groupBy().max().first()[0]


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory is read from /proc")
def test_workers_give_memory_back(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * 7919 + j * j) % 50_021}" for j in range(500))) for i in range(8000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = anonymous_mb(spark)
    packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), queries.pretoken_pattern()).write.parquet(str(tmp_path / "out"))
    assert anonymous_mb(spark) - before < 50  # the encoder stays; 36 with memory given back, 69 without
