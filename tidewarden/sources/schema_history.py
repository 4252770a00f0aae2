"""How the columns of stored files differ from a schema, and reading files of several ages as one table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Types that a file's column may be read as, beside its own: what Spark widens without loss.
WIDER = {"int": ("bigint", "double"), "smallint": ("int", "bigint", "double"), "tinyint": ("smallint", "int", "bigint", "double"), "float": ("double",), "timestamp_ntz": ("timestamp",), "timestamp": ("timestamp_ntz",), "date": ("timestamp_ntz",)}


def file_columns(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, column, type), one for each column of each Parquet file below ``path``, from the files' own footers. The footers
    are read by tasks; ``path`` is one that workers can open."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        from tidewarden.sources.capture_source import _open

        for frame in frames:
            rows = []
            for name in frame.path:
                system, inner = _open(name)
                rows += [(name, f.name, from_arrow_type(f.type).simpleString()) for f in pq.read_schema(inner, filesystem=system)]
            yield pd.DataFrame(rows, columns=["file", "column", "type"])

    return listed.mapInPandas(read, "file string, column string, type string")


def differences(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows (column, kind, stored, wanted, files): where files differ from ``schema``, and how many do. ``kind``: missing (read as
    null), extra (not read), widened (read without loss), narrowed (refused)."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    want = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in wanted], "column string, wanted string")
    have = file_columns(spark, path)
    files = have.select("file").distinct()
    every = files.crossJoin(F.broadcast(want)).join(have, ["file", "column"], "full")  # a file has few columns
    wide = F.coalesce(*(F.when((F.col("type") == a), F.col("wanted").isin(list(b))) for a, b in WIDER.items()), F.lit(False))
    kind = F.when(F.col("type").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("type") == F.col("wanted"), None).when(wide, "widened").otherwise("narrowed")
    return every.withColumn("kind", kind).where("kind is not null").groupBy("column", "kind", F.col("type").alias("stored"), "wanted").agg(F.count(F.lit(1)).alias("files"))


def read_evolved(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The files below ``path`` as one table of ``schema``: columns that a file lacks are null, columns of narrower types are widened;
    where a type would lose values, ValueError says so and nothing is read."""
    refused = differences(spark, path, schema).where("kind = 'narrowed'").orderBy("column").collect()
    if refused:
        raise ValueError("types that can't be read without loss: " + ", ".join(f"{r.column} {r.stored} as {r.wanted}" for r in refused))
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(wanted).parquet(path)
