"""Event tables that grow: parquet folders as streams, and windowed aggregates with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import compiler
from ..plans.expressions import EVENTS
from ..plans.parser import QueryError, parse

#: Operators that a stream can run as they are: each row alone.
ROW_WISE = {"filter", "select", "contains", "replace", "uppercase", "lowercase", "trim", "abs", "round", "floor", "ceil", "len", "asDateTime", "formatDuration", "truncate"}


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def query(df: DataFrame, text: str) -> DataFrame:
    """A query of row-wise operators over a stream; its type name is not looked up."""
    q = parse(text)
    other = [op.name for op in q.ops if op.name not in ROW_WISE]
    if other:
        raise QueryError(f"not for streams: {', '.join(other)}")
    return compiler.compile_query(q, compiler.Rows(df, EVENTS)).df


def windowed(df: DataFrame, time: str, size: str, keys: list[str], value: str | None = None, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts (and sums of a value) by time window and keys; windows close when the watermark, `late` behind the newest time, passes them."""
    w = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    aggs = [F.count("*").alias("count"), *([F.sum(value).alias("sum")] if value else [])]
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "count", *(["sum"] if value else []))
