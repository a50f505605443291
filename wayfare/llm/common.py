"""What the text operators share: input columns, tables written to the shared folder, vocabularies."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.shared import discard, new_dir, settled, shared_dir

__all__ = ["discard", "new_dir", "read_vocabulary", "settled", "shared_dir", "table", "text_or_empty", "vocabulary_path", "whole"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def whole(docs: DataFrame) -> Column:
    """A row of docs as one column, apart from what an operator adds, whatever the columns' names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> str:
    """A vocabulary's JSON text. It goes to the executors with the task; its size is checked here."""
    size = os.path.getsize(path)
    if size > 32 << 20:
        raise ValueError(f"{path} has {size} bytes; vocabularies of up to 32 MB are sent to the executors")
    with open(path, encoding="utf-8") as f:
        return f.read()
