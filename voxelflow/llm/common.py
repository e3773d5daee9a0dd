"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder as shared_folder, stored  # noqa: F401

#: The characters that separate words and that exact comparison ignores: `[\x20\x09-\x0D]`.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: What steps keep in a worker between tasks, by the step's name: how to forget it.
KEPT: dict[str, Callable[[], object]] = {}


def tidy(step: Step, keeps: str = "") -> Step:
    """A step for mapInArrow that begins without what other steps have kept in its worker, and gives free memory back at its end.

    Spark uses a Python worker for many tasks, of one operator after another, and counts all of its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from voxelflow.llm import common as here  # the worker's own module, not what was sent with this function

        for name, forget in here.KEPT.items():
            if name != keeps:
                forget()
        yield from step(batches)
        here.trim()

    return run


def trim() -> None:
    """Give this process's free memory back to the machine."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
