"""Helpers shared by the training-data operators: tables, shared scratch space and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a local one is made for a local master;
    on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and (sc.master or "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="leafspark-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, so that a batch of long texts stays within a worker's memory. A size that
    is lower already stays."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafspark/{name}-{uuid.uuid4().hex[:12]}"


#: The tables that keep() has made and nothing has deleted.
_made: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts the lineage, and survives the loss of an executor. A join of
    two tables so kept, or of one with a shuffle, is one whose skewed keys Spark can split."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, name: str, make) -> DataFrame:
    """keep() of what make() gives; then the tables kept on the way to it are deleted."""
    before = len(_made)
    out = keep(make(), name)
    ways, _made[before:] = _made[before:-1], _made[-1:]
    _delete(spark, ways)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver let go of plans that nothing refers to any more, so that Spark deletes their shuffle files before
    the next steps make theirs."""
    gc.collect()
    spark._jvm.System.gc()


def written(spark: SparkSession, folder: str) -> list[str]:
    """The names of the tables in a folder that are written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return [n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by keep(), once nothing reads it any more."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def clear(spark: SparkSession) -> None:
    """Deletes all tables that keep() has made in this process: for when no result is read any more."""
    _delete(spark, _made)
    _made.clear()


def arrow_map(df: DataFrame, rows, schema: str) -> DataFrame:
    """Applies rows(batch as lists by column) -> columns as lists, batch by batch, on the executors."""
    small_batches(df.sparkSession)
    names = df.columns
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = rows(*(batch.column(i).to_pylist() for i in range(len(names))))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(got, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def arrow_filter(df: DataFrame, column: str, keeps) -> DataFrame:
    """The rows of df for which keeps(values of a column as a list) gives True; all columns pass as they are."""
    small_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keeps(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def least_hashed(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """The `most` rows of least hash `by`; all rows where there are no more. Where there are many more, a quantile of
    the hash leaves out those far above first: else every task would send the one that merges as many."""
    n = rows.count()
    if n <= most:
        return rows
    if n > 4 * most:
        bound = rows.agg(F.percentile_approx(by, 2 * most / n, max(10_000, 4 * n // most))).first()[0]
        rows = rows.where(by <= bound)
    return rows.orderBy(by).limit(most)


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: then each b is the least node of all that hang on it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node of its connected component.

    Alternating large-star and small-star steps until only stars are left. Each step is a min by key (combined before
    the shuffle) and a join back, so a hub costs as many rows as it has edges; the mins are kept first, so that Spark can
    split the rows of a hub in the join. Nothing is collected.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        two = both_ways(now)
        low = keep(two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "large")
        lower = keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        older, now = now, keep(small, "edges")
        for done in (older, low, large, lower):
            drop(done)
        del two, low, large, lower, small, older
        release(now.sparkSession)
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def hex16(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
