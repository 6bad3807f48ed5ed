"""Runs byte kernels document by document in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Documents in one Arrow batch: a batch of large files must fit in a worker.
BATCH = 64
#: Rows that a kernel gathers before it passes them on.
FLUSH = 5000


def per_row(df: DataFrame, kernel: Callable[..., list[tuple] | Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that kernel(*columns) gives for each row of df, in the columns of schema."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(kernel(*values))
                if len(rows) >= FLUSH:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    return df.mapInArrow(run, out)
