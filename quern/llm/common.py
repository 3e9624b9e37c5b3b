"""Helpers shared by the training-data operators: inputs, and the engine's scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.scratch import release, scratch_table

__all__ = ["free_name", "read_table", "release", "scratch_table", "trimmed"]

T = TypeVar("T")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as no column of ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def trimmed(results: Iterator[T]) -> Iterator[T]:
    """``results`` of a Python worker's task; at their end freed memory goes back to the system.

    Workers outlive their tasks, and the C library keeps what a task has freed: after texts and their
    tokens, a worker held over twice what it used, beside the executor's JVM, through all later stages.
    """
    yield from results
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
