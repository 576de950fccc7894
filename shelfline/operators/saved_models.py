"""Fitted models kept as rows of a table: versions of a name, the latest wins, a pin beats the latest."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting

MODELS = "name string, version int, saved_at timestamp, signature string, model string, meta string"
PINS = "name string, version int, pinned_at timestamp"
#: A new model is taken over where its WAPE is lower by so many points and its bias isn't below the least.
LEAST_GAIN, LEAST_BIAS = 0.2, -6.0


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of all names, without the models themselves, and which version of a name is served."""
    every, pins = _rows(spark, f"{folder}/models", MODELS), _rows(spark, f"{folder}/pins", PINS)
    newest = Window.partitionBy("name")
    last = pins.groupBy("name").agg(F.max_by("version", "pinned_at").alias("pinned"))
    held = F.first(F.when(F.col("version") == F.col("pinned"), F.col("pinned")), True).over(newest)
    told = every.join(last, "name", "left").withColumn("serves", F.coalesce(held, F.max("version").over(newest)))
    return told.select("name", "version", "saved_at", "signature", "meta", (F.col("version") == F.col("serves")).alias("served"))


def save(spark: SparkSession, folder: str, name: str, model: str, signature: str = "", meta: dict | None = None) -> int:
    """Adds a version. signature: of the data it was fitted to; meta: anything else, as JSON."""
    version = (_rows(spark, f"{folder}/models", MODELS).filter(F.col("name") == name).agg(F.max("version").alias("v")).first().v or 0) + 1
    row = spark.createDataFrame([(name, version, signature, model, json.dumps(meta or {}))], "name string, version int, signature string, model string, meta string")
    row.withColumn("saved_at", F.current_timestamp()).select(*(c.split()[0] for c in MODELS.split(", "))).coalesce(1).write.mode("append").parquet(f"{folder}/models")
    return version


def pin(spark: SparkSession, folder: str, name: str, version: int | None) -> None:
    """Serves a version whatever comes after it; None: the latest again. A pin on a version that isn't there counts for
    nothing."""
    row = spark.createDataFrame([(name, version)], "name string, version int").withColumn("pinned_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/pins")


def load(spark: SparkSession, folder: str, name: str, version: int | None = None):
    """The row of a name's version, of the served one where None; None where there is none."""
    wanted = saved(spark, folder).filter(F.col("name") == name).filter(F.col("version") == version if version else F.col("served")).select("name", "version")
    found = _rows(spark, f"{folder}/models", MODELS).join(wanted, ["name", "version"]).limit(1).collect()
    return found[0] if found else None


def adopted(new: dict, old: dict | None) -> bool:
    """Whether a new model takes over from the one on record, by WAPE and bias on the same held-out cells."""
    return old is None or (old["wape"] - new["wape"] >= LEAST_GAIN and new["bias"] >= LEAST_BIAS)


def trained(spark: SparkSession, folder: str, name: str, rows: DataFrame, features: list[str], signature: str, rounds: int = boosting.ROUNDS) -> tuple[boosting.Trees, int]:
    """The served boosted model of a name, and its version. A model whose signature is that of the data comes from the
    table as it is; else boosting goes on from the served model (from nothing where there is none) and the result is saved."""
    row = load(spark, folder, name)
    if row is not None and row.signature == signature:
        return boosting.Trees.from_json(row.model), row.version
    model = boosting.fit(rows, features, rounds=rounds, start=boosting.Trees.from_json(row.model) if row is not None else None)
    version = save(spark, folder, name, model.to_json(), signature, {"trees": len(model.trees), "deviance": model.deviance[-1] if model.deviance else None, "warm": row is not None})
    return model, version
