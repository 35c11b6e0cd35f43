"""Helpers of this subpackage: tables kept in the shared folder, text bytes in blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ductlake-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict[tuple, object] = {}


def hold(key: tuple, make: Callable[[], object]) -> object:
    """A large object that a Python worker keeps from task to task, one at a time: another one takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what an earlier operator left in this worker."""
    _HELD.clear()


BLOCK = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def byte_blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a text in blocks of about `size`, cut at white space; a longer word stays whole."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def words(text: str | None) -> Iterator[list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, as UTF-8, in lists of bounded length."""
    for block in byte_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        yield block.split()
