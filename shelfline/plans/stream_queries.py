"""Streaming jobs run to the end of the stage log."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import functions as F

from ..streaming import jobs
from . import entry_queries
from .registry import register
from .views import using

#: Places in a branch's order of arrival, two for each note, that one load brings at most.
LOAD_PLACES = 200_000


@register("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, COUNT(*) AS events, MIN(event_id) AS first_event, MAX(event_id) AS last_event
    FROM events GROUP BY 1, 2""")
def stream_weekly_counts(spark, sf_dir):
    table = jobs.run_to_table(jobs.weekly_counts(jobs.events(spark, sf_dir)), "weekly-counts", ["week", "event_type"])
    return table.selectExpr("cast(week.start as date) as week_start", "event_type", "events", "first_event", "last_event")


@register("""SELECT bo_no, event_id, to_stage, next_us - at_us AS stay_us FROM (SELECT user_id AS bo_no, event_id, event_type AS to_stage, epoch_us(ts) AS at_us,
    LEAD(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us FROM events) WHERE next_us IS NOT NULL""")
def stream_stage_stays(spark, sf_dir):
    return jobs.run_to_table(jobs.stage_stays(jobs.events(spark, sf_dir)), "stage-stays")


@register(using("dn", f"SELECT * EXCLUDE (is_open) FROM ({entry_queries._ACCUMULATED}) WHERE NOT is_open", seq=entry_queries._SEQ))
def stream_closed_back_orders(spark, sf_dir):
    """The back orders that notes have filled and a close has put out, from notes that come in two loads or more: the job ends
    after each and goes on from its checkpoint, with the open orders of all branches as its state. One ends at a
    quarter of the longest branch, and none has more than LOAD_PLACES, so that what a worker holds of a branch doesn't grow."""
    folder, notes = jobs.work_folder(spark, "closed-back-orders"), entry_queries.noted(spark, sf_dir).persist()
    try:
        last = notes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first().m
        ends = [-1, *range(last // 4, 0, -LOAD_PLACES)[::-1], *range(last // 4 + LOAD_PLACES, last, LOAD_PLACES), last]
        ends = [-1, last // 4, last] if last < 4 else ends
        for i, (begin, end) in enumerate(pairwise(ends)):
            notes.filter((F.col("seq") > begin) & (F.col("seq") <= end)).write.parquet(f"{folder}/in/{i}")
            stream = jobs.accumulate(spark.readStream.schema(notes.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
            writer = stream.writeStream.option("checkpointLocation", f"{folder}/c").format("parquet").option("path", f"{folder}/out")
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        notes.unpersist()
    return spark.read.parquet(f"{folder}/out")


@register(using("dn", f"SELECT * EXCLUDE (decision) FROM ({entry_queries._MERGED_PARTS})", **entry_queries._PART_VIEWS))
def stream_month_parts(spark, sf_dir):
    """Months on record and two uploads of parts of them, the first two in one batch."""
    folder = jobs.work_folder(spark, "month-parts")
    for i, rows in enumerate(entry_queries.month_parts(spark, sf_dir).values()):
        rows.coalesce(1).write.parquet(f"{folder}/in/{i}")
        if i:
            schema = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/in").schema
            jobs.merge_parts(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"), f"{folder}/table", f"{folder}/c")
    return spark.read.parquet(f"{folder}/table")
