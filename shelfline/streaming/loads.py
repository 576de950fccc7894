"""Loads that take effect exactly once, tables that are rebuilt where their input differs, and weeks in which real
readings take the place of simulated ones. All jobs end when what has come is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import weeks


def signed(columns: list[str]) -> list[Column]:
    """Aggregates that tell one set of rows from another whatever their order: how many there are and the sum of a
    60-bit hash of each, in which null and empty values differ and repeated rows count."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(columns)]
    hashed = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(hashed).cast("string").alias("digest")]


def signature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows and digest of each group of rows with the same keys; a partial sum of each task is all that moves."""
    return rows.groupBy(*keys).agg(*signed([c for c in rows.columns if c not in keys]))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def put_parts(rows: DataFrame, target: str, keys: list[str], draft: str) -> None:
    """Replaces the partitions of the table at target that rows has. rows may be derived from the table itself, so it is
    written aside first; whoever runs again after a stop writes the same partitions again."""
    rows.repartition(*keys).write.mode("overwrite").parquet(draft)
    again = rows.sparkSession.read.schema(rows.schema).parquet(draft)
    again.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)


LOADS = "load string, rows long, digest string, batch long, loaded_at timestamp"


def _new_loads(batch: DataFrame, target: str, number: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of a batch with `load` and `load_time` on each row: the rows that count, and the record of their loads. Loads of the
    same id and content as one on record are left out; of loads with the same keys the latest counts."""
    spark, own = batch.sparkSession, [c for c in batch.columns if c not in ("load", "load_time")]
    seen = batch.groupBy("load").agg(*signed(own), F.max("load_time").alias("loaded_at"))
    known = _read(spark, f"{target}/loads", LOADS)
    fresh = seen.join(known, ["load", "rows", "digest"], "left_anti")
    some = batch.join(fresh.select("load"), "load", "left_semi")
    last = some.groupBy(*keys).agg(F.max(F.struct("load_time", "load")).alias("__last")).select(*keys, F.col("__last.load").alias("load"))
    return some.join(last, [*keys, "load"], "left_semi").drop("load_time"), fresh.withColumn("batch", F.lit(number).cast("long"))


def load_once(
    spark: SparkSession, folder: str, schema: str, target: str, keys: list[str], checkpoint: str, simulated: bool = False, then: Callable[[DataFrame, int], None] | None = None
) -> None:
    """Loads the Parquet files that have come into a folder: a load is a file, and its rows replace all rows with the same
    keys in the table {target}/data, which is partitioned by the keys and `simulated`, so that simulated rows never replace
    real ones nor the other way round.

    {target}/loads has id, signature and time of every load. A load that comes again, by a retry, a replay of its batch or
    a second copy of its file, changes nothing; the same id with other contents is a new load. then(keys that changed,
    batch) runs after the data of a batch are written, and their record comes last, so what was cut off before that is done
    again in full."""
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    tagged = files.select("*", F.col("_metadata.file_name").alias("load"), F.col("_metadata.file_modification_time").alias("load_time"))

    def put(batch: DataFrame, number: int) -> None:
        rows, record = _new_loads(batch, target, number, keys)
        rows = rows.withColumn("simulated", F.lit(simulated))
        record = spark.createDataFrame(record.select(*(c.split()[0] for c in LOADS.split(", "))).collect(), LOADS)  # a row a file
        if record.isEmpty():
            return
        put_parts(rows, f"{target}/data", [*keys, "simulated"], f"{checkpoint}-draft/{number}")
        if then:
            then(rows.select(*keys).distinct(), number)
        record.write.mode("append").parquet(f"{target}/loads")

    tagged.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table_of(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What load_once() has put into {target}/data."""
    return _read(spark, f"{target}/data", f"{schema}, load string, simulated boolean")


def signatures(spark: SparkSession, target: str, keys: DataFrame) -> tuple[DataFrame, int]:
    """The signatures that the table at target was last built from, and their version; empty and 0 where there are none."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    every = _read(spark, f"{target}/signatures", f"{fields}, rows long, digest string, version int")
    version = every.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v
    return every.filter(F.col("version") == version).drop("version"), version


def refresh(source: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], target: str) -> int:
    """Brings the table at {target}/data, build(source) in partitions by keys, up to date and says which version it has.

    The signature of each partition of the source is held against that of the last build; build runs over the partitions
    that differ, and where none does nothing is written and the version stays. Signatures are written last: what was cut
    off before is built again. Partitions that the source no longer has lose their signature, and with it their place in
    refreshed(). Each row says in `built` at which version its partition was made. No key is null."""
    spark = source.sparkSession
    before, version = signatures(spark, target, source.select(*keys))
    now = signature(source, keys).persist()
    try:
        differs = now.join(before, [*keys, "rows", "digest"], "left_anti").select(*keys)
        gone = before.join(now, keys, "left_anti")
        changed = not differs.isEmpty()
        if not changed and gone.isEmpty():
            return version
        if changed:
            rows = build(source.join(differs, keys, "left_semi")).withColumn("built", F.lit(version + 1))
            put_parts(rows, f"{target}/data", keys, f"{target}/draft")
        now.write.mode("overwrite").parquet(f"{target}/signatures/version={version + 1}")
    finally:
        now.unpersist()
    return version + 1


def refreshed(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The table that refresh() keeps."""
    rows = spark.read.parquet(f"{target}/data")
    current, _ = signatures(spark, target, rows.select(*keys))
    return rows.join(current.select(*keys), keys, "left_semi")


MONTHS = "branch string, period date, sku string, item string, qty long, turnover_cents long, day_from int, day_to int"
WEEKS = "branch string, week_start date, sku string, item string, qty double, turnover double"


def weeks_of(spark: SparkSession, target: str) -> DataFrame:
    """The weekly table that load_months() and load_weeks() keep."""
    return _read(spark, f"{target}/weeks", f"{WEEKS}, simulated boolean, month date").filter("sku IS NOT NULL").drop("month")


def _rebuild(spark: SparkSession, target: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Makes the weeks anew that overlap the touched months (branch, period) and no others. A month that is left without
    rows keeps one without a product, so that its old rows go."""

    def then(touched: DataFrame, number: int) -> None:
        months = table_of(spark, f"{target}/months", MONTHS).drop("load", "simulated")
        real = table_of(spark, f"{target}/real", f"{WEEKS}, month date").drop("load", "simulated", "month")
        parts = weeks.touched_parts(touched)
        rows = weeks.rebuilt_parts(months, real, parts)
        put_parts(rows.unionByName(parts, allowMissingColumns=True), f"{target}/weeks", ["branch", "month"], f"{checkpoint}-weeks-draft/{number}")

    return then


def load_months(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Loads files of MONTHS, each replacing the months of the branches it has, and makes the weeks over these anew."""
    load_once(spark, folder, MONTHS, f"{target}/months", ["branch", "period"], checkpoint, then=_rebuild(spark, target, checkpoint))


def load_weeks(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Loads files of WEEKS and `month` (in which the week begins), each replacing its branches' weeks of those months; the
    simulated weeks around them make way. A real week touches every month that it has days in."""
    rebuild = _rebuild(spark, target, checkpoint)

    def then(touched: DataFrame, number: int) -> None:
        rebuild(touched.select("branch", F.explode(F.array("month", F.add_months("month", 1))).alias("period")).distinct(), number)

    load_once(spark, folder, f"{WEEKS}, month date", f"{target}/real", ["branch", "month"], checkpoint, then=then)
