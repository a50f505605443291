"""Run an encoder over a text column: one Arrow batch at a time, a vocabulary object for each process."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import read_vocabulary
from .pieces import once


def map_texts(df: DataFrame, text: str, keys: list[str | Column], vocabulary: str, kind: type, row: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """For each row, row(value of its text by kind) gives tuples; each becomes a row after the row's keys.

    The vocabulary is broadcast; read_vocabulary checks its size. Nulls in keys pass through; a null text is empty.
    """
    spark = df.sparkSession
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    inner = df.select(*keys, df[text].alias("__text"))
    names = inner.columns[:-1]
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]] + [schema])
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    key_count = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what the encoders remember holds no cycles
        coder = once(kind, blob.value)
        for batch in batches:
            texts = batch.column(key_count)
            pos, rows = [], []
            for i, value in enumerate(coder.many(t.as_py() or "" for t in texts)):
                for r in row(value):
                    pos.append(i)
                    rows.append(r)
            head = [batch.column(k).take(pa.array(pos, pa.int32())) for k in range(key_count)]
            columns = list(zip(*rows)) or [()] * len(fields)
            tail = [pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(head + tail, names=names + [n.strip("`") for n, _ in fields])

    return inner.mapInArrow(run, full)
