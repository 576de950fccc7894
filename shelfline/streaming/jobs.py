"""Structured Streaming jobs over the stage log. Each runs with the availableNow trigger: it takes what has come since
its checkpoint and ends."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of one frame that closed back orders are put out in.
ROWS_AT_ONCE = 50_000


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a local one only where that is unset and Spark runs on this machine alone."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-', dir='/tmp')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read back, for what several plans read."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """The stage log as a stream of the folder's files of that name."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def weekly_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Events of each type in weeks that begin on Monday; state of weeks older than the watermark is dropped."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days", "7 days", "4 days")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(week.alias("week"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def stage_stays(stream: DataFrame, idle_days: int = 365) -> DataFrame:
    """bo_no, event_id, to_stage, stay_us: how long an order stays in a stage, told when its next event comes. State is
    one event for each order, and none after idle_days without one. Events that come after a later one of their order has
    been told are left out: the stay that they would divide is told already."""

    def next_of(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at_us", "event_id"])
        if state.exists:
            event_id, to_stage, at_us = state.get
            rows = rows[(rows["at_us"] > at_us) | ((rows["at_us"] == at_us) & (rows["event_id"] > event_id))]
            rows = pd.concat([pd.DataFrame({"event_id": [event_id], "to_stage": [to_stage], "at_us": [at_us]}), rows])
        state.update((int(rows["event_id"].iloc[-1]), rows["to_stage"].iloc[-1], int(rows["at_us"].iloc[-1])))
        state.setTimeoutTimestamp(max(int(rows["at_us"].iloc[-1]) // 1000 + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        stays = rows["at_us"].to_numpy()
        yield pd.DataFrame({"bo_no": key[0], "event_id": rows["event_id"].to_numpy()[:-1], "to_stage": rows["to_stage"].to_numpy()[:-1], "stay_us": stays[1:] - stays[:-1]})

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{idle_days} days")
    rows = timed.select(F.col("user_id").alias("bo_no"), "event_id", F.col("event_type").alias("to_stage"), "ts", F.unix_micros("ts").alias("at_us"))
    return rows.groupBy("bo_no").applyInPandasWithState(next_of, "bo_no long, event_id long, to_stage string, stay_us long", "event_id long, to_stage string, at_us long", "append", GroupStateTimeout.EventTimeTimeout)


def ledger(changes: DataFrame) -> DataFrame:
    """changes: branch_id, product_id, seq, change. The balance after each line in order of arrival (of seq within a
    batch), never below zero. State is one balance for each branch and product."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        start = state.get[0] if state.exists else 0
        running = start + rows["change"].cumsum()
        balance = running - running.cummin().clip(upper=0)
        state.update((int(balance.iloc[-1]),))
        yield pd.DataFrame({"branch_id": key[0], "product_id": key[1], "seq": rows["seq"], "change": rows["change"], "balance": balance})

    return changes.groupBy("branch_id", "product_id").applyInPandasWithState(fold, "branch_id long, product_id long, seq long, change long, balance long", "balance long", "append", GroupStateTimeout.NoTimeout)


def filled(branch: str, parts: Iterator[pd.DataFrame], held: dict) -> Iterator[pd.DataFrame]:
    """The rows (bo_no, notes, product_id, qty_ordered) that the closes among a branch's notes put out, at most
    ROWS_AT_ONCE in a frame; held, the branch's state, is changed to what is open after the last note. parts: seq, close,
    week (ISO year and week as yyyyww), products and qtys (arrays of what a note is short of). Of the notes flat arrays are
    held, a few numbers for each, as they come in no order."""
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for part in parts:
        flat = [part[c].to_numpy(np.int64) for c in ("seq", "close", "week")] + [part["products"].map(len).to_numpy(np.int64)]
        flat += [np.concatenate([np.zeros(0, np.int64), *part[c]]).astype(np.int64) for c in ("products", "qtys")]
        for column, values in zip(columns, flat):
            column.append(values)
    seq, close, week, sizes, products, qtys = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    del columns
    order = np.argsort(seq, kind="stable")
    close, week = close[order] > 0, week[order]
    group = np.cumsum(close)  # how many closes a note has before it
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = group[place[np.repeat(np.arange(len(sizes)), sizes)]]
    closes, now = int(close.sum()), held["open"]
    notes = np.bincount(group[~close], minlength=closes + 1)
    names = np.full(closes + 1, None, object)
    if now:
        short = now["short"]
        of, products, qtys = np.r_[np.zeros(len(short), np.int64), of], np.r_[np.array(list(short), np.int64), products], np.r_[np.array(list(short.values()), np.int64), qtys]
        names[0], notes[0] = now["bo_no"], notes[0] + now["notes"]
    begun, first = np.unique(group[~close], return_index=True)
    for g, at in zip(begun.tolist(), week[~close][first].tolist()):
        if names[g] is None:
            year, base = at // 100, f"BO-{branch}-{at // 100}W{at % 100:02d}"
            if year != held.get("year"):
                held["used"], held["year"] = {k: v for k, v in held["used"].items() if int(k.rsplit("-", 1)[1][:4]) >= year - 1}, year
            n = held["used"][base] = held["used"].get(base, 0) + 1
            names[g] = base if n == 1 else f"{base}-{n}"
    by = np.lexsort((products, of))
    of, products, qtys = of[by], products[by], qtys[by]
    starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (products[1:] != products[:-1])][: len(of)])
    sums = np.add.reduceat(qtys, starts) if len(starts) else qtys
    of, products = of[starts], products[starts]
    out = int(np.searchsorted(of, closes))
    held["open"] = {"bo_no": names[closes], "notes": int(notes[closes]), "short": {str(p): q for p, q in zip(products[out:].tolist(), sums[out:].tolist())}} if names[closes] is not None else None
    for at in range(0, out, ROWS_AT_ONCE):
        some = slice(at, min(out, at + ROWS_AT_ONCE))
        yield pd.DataFrame({"bo_no": names[of[some]], "notes": notes[of[some]], "product_id": products[some], "qty_ordered": sums[some]})


def accumulate(notes: DataFrame) -> DataFrame:
    """entry.accumulated() as a stream: notes (branch_id, branch, seq, kind, dn_no, doc_date, shorts) load the branch's open
    back order, and a CLOSE puts out its rows: branch_id, bo_no, notes, product_id, qty_ordered. State of a branch is its
    open order as JSON and how often each number has been used this year and last."""
    names = ["branch_id", "bo_no", "notes", "product_id", "qty_ordered"]

    def load(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": None, "used": {}}
        head = next(parts)
        for frame in filled(head["branch"].iloc[0], chain([head], parts), held):
            yield frame.assign(branch_id=key[0])[names]
        state.update((json.dumps(held),))

    close = F.col("kind") == "CLOSE"
    week = F.when(close, 0).otherwise(F.extract(F.lit("YEAROFWEEK"), "doc_date") * 100 + F.weekofyear("doc_date"))
    flat = notes.select("branch_id", "branch", "seq", close.cast("int").alias("close"), week.alias("week"), F.col("shorts.product_id").alias("products"), F.col("shorts.qty").alias("qtys"))
    return flat.groupBy("branch_id").applyInPandasWithState(load, "branch_id long, bo_no string, notes long, product_id long, qty_ordered long", "held string", "append", GroupStateTimeout.NoTimeout)


def merge_parts(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Uploads of parts of months (branch, period, sku, item, qty, turnover_cents, day_from, day_to) merged into the Parquet
    table at target by entry.merged_month(): only the partitions (branch, period) of a batch are read and replaced. Each
    file is a part; those of a batch are merged in order of their time and name. A batch that runs again finds its days in
    the table and changes nothing."""
    from ..operators.entry import merged_month

    schema = "sku string, item string, qty long, turnover_cents long, day_from int, day_to int, branch string, period date"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*(F.col(c.split()[0]) for c in schema.split(", ")), "part")
        keys = new.select("branch", "period").distinct()
        try:
            table = spark.read.schema(schema).parquet(target)
            old = table.join(F.broadcast(keys), ["branch", "period"], "left_semi").select(new.drop("part").columns)  # a row for each month of the batch
        except AnalysisException:  # nothing is there yet
            old = spark.createDataFrame([], new.drop("part").schema)
        draft = f"{checkpoint}-draft/{number}"
        merged_month(old, new).drop("decision").write.mode("overwrite").parquet(draft)
        spark.read.parquet(draft).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch", "period").parquet(target)

    part = F.concat_ws(" ", F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "_metadata.file_name")
    named = stream.select("*", part.alias("part"))
    named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_by_key(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> None:
    """Rows of a batch replace all rows with the same partition keys in the Parquet table at target."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(frame: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to its end and reads what it wrote. With keys it runs in update mode: each batch adds the rows it
    changed, and of a key the row of the last batch counts; without, in append mode."""
    spark = frame.sparkSession
    folder = work_folder(spark, name)
    writer = frame.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if keys is None:
        writer.outputMode("append").format("parquet").option("path", f"{folder}/table").start().awaitTermination()
        return spark.read.parquet(f"{folder}/table")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    writer.outputMode("update").foreachBatch(put).start().awaitTermination()
    latest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(f"{folder}/table").withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1").drop("__rank", "batch")
