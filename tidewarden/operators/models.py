"""Letter-pair models as versioned tables, and their training from files of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.names import canonicalize
from tidewarden.operators import training
from tidewarden.operators.scorers import bigram_llr

KIND = "bigram_v1"


def corpus(spark: SparkSession, path: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Rows (label), distinct: the registrants' labels of the names in text files, words by white space, lines that begin with
    # skipped. A word without a dot is a label itself; what is no name is left out."""
    from tidewarden.dims import word_list

    named = canonicalize(word_list(spark, path), "word", suffixes)
    return named.where("name.sld is not null").select(F.col("name.sld").alias("label")).distinct()


def train(labels: DataFrame) -> dict:
    """As ``training.bigram_model``, with how many labels there were and the range of their scores."""
    model = training.bigram_model(labels)
    x = bigram_llr(F.lower("label"), model["log_probs"], model["uniform"], digits=True)
    r = labels.select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    return model | {"corpus_size": r.n, "min": r.low or 0.0, "max": r.high or 0.0}


def save(spark: SparkSession, model: dict, path: str) -> int:
    """Stores a model as the next version below ``path``; returns the version. A version is there once both its tables are,
    the calibration last. Versions aren't written over."""
    version = 1 + max((r.version for r in versions(spark, path).select("version").collect()), default=0)
    pairs = [(k[0], k[1], float(v)) for k, v in model["log_probs"].items()]
    spark.createDataFrame(pairs, "prev string, next string, log_prob double").coalesce(1).write.mode("overwrite").parquet(f"{path}/pairs/version={version}")
    row = [(KIND, training.ALPHABET, training.SMOOTHING, int(model.get("corpus_size", 0)), *(float(model.get(c, 0.0)) for c in ("uniform", "mean", "std", "min", "max")))]
    spark.createDataFrame(row, CALIBRATION).withColumn("stored", F.current_timestamp()).coalesce(1).write.mode("error").parquet(f"{path}/calibration/version={version}")
    return version


CALIBRATION = "kind string, alphabet string, smoothing double, corpus_size long, uniform double, mean double, std double, min double, max double"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``CALIBRATION`` with version and stored, one for each version; none before the first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/calibration")
    schema = f"{CALIBRATION}, stored timestamp, version int"
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/calibration")


def load(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The model of a version, the last by default, as ``analysis.analyze`` takes it."""
    found = versions(spark, path)
    found = found.where(F.col("version") == version) if version is not None else found.orderBy(F.desc("version"))
    r = found.first()
    if r is None:
        raise LookupError(f"no such model: {path}" + (f", version {version}" if version is not None else ""))
    if r.kind != KIND or r.alphabet != training.ALPHABET:
        raise ValueError(f"a model of another kind: {r.kind}")
    pairs = spark.read.parquet(f"{path}/pairs/version={r.version}").collect()  # 38 x 38
    return {"log_probs": {p.prev + p.next: p.log_prob for p in pairs}, **{c: r[c] for c in ("uniform", "mean", "std", "min", "max", "corpus_size", "version")}}
