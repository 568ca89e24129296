"""Shared helpers: reading tables, folds, cutting long texts, and task-side iteration."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Long texts are worked on in pieces of about this many characters.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text, modulo `parts`; a null key is fold -1, in training and never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(-1))


def clear(text) -> str:
    """Null texts count as empty."""
    return text if isinstance(text, str) else ""


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut only in front of white space, so that no word is split."""
    at, end = 0, len(text)
    while end - at > size:
        found = SPACE.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def send(spark: SparkSession, model):
    """Broadcast a dataclass as plain data; the returned function rebuilds it in a task, its `data` is the broadcast."""
    kind, data = type(model), spark.sparkContext.broadcast(vars(model))

    def get():
        return kind(**data.value)
    get.data = data
    return get
