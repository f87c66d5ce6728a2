"""Queries of the incremental jobs: tables replayed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint
from tessera.plans.registry import query
from tessera.sources.scratch import scratch
from tessera.streaming import incremental as op
from tessera.streaming import keyed, records, reindex


def _arrivals(rows: DataFrame) -> list[DataFrame]:
    """The rows in three arrivals."""
    return [rows.where(F.col("event_id") % 3 == n) for n in range(3)]


def _three_batches() -> str:
    """What is new in each of three batches: keys not known yet, then the first row of each post, then of each url."""
    steps = ["with e as (select event_id, user_id || '/' || cast(json_extract(props, '$.k') as int) as post, user_id || '-' || cast(floor(value) as int) as url from events), known0 as (select * from e where false)"]
    for i in range(3):
        steps.append(f"c{i} as (select * from e where event_id % 3 = {i} and post not in (select post from known{i}) and url not in (select url from known{i}))")
        steps.append(f"p{i} as (select * from c{i} qualify row_number() over (partition by post order by event_id) = 1)")
        steps.append(f"u{i} as (select * from p{i} qualify row_number() over (partition by url order by event_id) = 1)")
        steps.append(f"known{i + 1} as (select * from known{i} union all select * from u{i})")
    return ", ".join(steps) + " select event_id, post, url from known3"


@query(_three_batches(), "events")
def t1_incremental_dedupe_any_key(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", F.concat_ws("/", "user_id", F.get_json_object("props", "$.k")).alias("post"), F.concat_ws("-", "user_id", F.floor("value")).alias("url"))
    return keyed.deduplicated_stream(rows.sparkSession, _arrivals(rows), rows.schema, scratch(rows.sparkSession, "posts"), ["post", "url"], "event_id", F.col("post").isNotNull())


@query("select event_id from events where ts > (select max(ts) from events where ts < (select date_trunc('day', max(ts)) from events))", "events")
def t2_resume_from_progress(events: DataFrame) -> DataFrame:
    """A log of all events is read up to today, the job stops and goes on from its checkpoint; the result is what it read then."""
    spark, timed = events.sparkSession, events.where(F.col("ts").isNotNull())
    log, progress, target = (scratch(spark, name) for name in ("log", "progress", "recorded"))
    records.append_log(timed, log, "events-0", ["ts", "event_id"])
    today = timed.agg(F.date_trunc("day", F.max("ts")).alias("today"))  # one row
    before = timed.join(F.broadcast(today), F.col("ts") < F.col("today")).count()
    schema = events.select("event_id").schema

    def record(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    records.resume(spark, log, schema, progress, record, before)
    records.resume(spark, log, schema, progress, record)
    recorded = spark.read.schema("event_id long, batch int").parquet(target)
    return recorded.where(F.col("batch") > 0 if before else F.lit(True)).select("event_id")


@query("select doc_id, case when doc_id % 5 = 0 then 'other version' when doc_id % 7 = 0 then 'content changed' when doc_id % 3 = 0 then 'finished part changed' else 'valid' end as reason from documents", "documents")
def t3_resume_state_validation(documents: DataFrame) -> DataFrame:
    now = documents.select("doc_id", F.lit(1).alias("now_version"), F.col("source").alias("now_target"), F.size(F.split("text", "\n")).alias("now_blocks"), fingerprint(F.col("text")).alias("now_content"), F.md5(F.left("text", F.lit(50))).alias("now_prefix"))
    state = now.select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("now_version")).alias("version"), F.col("now_target").alias("target"), F.col("now_blocks").alias("blocks"),
        F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("now_content")).alias("content"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("now_prefix")).alias("prefix"),
    )
    return state.join(now, "doc_id").select("doc_id", op.state_reason().alias("reason"))


@query("select user_id, event_id, lpad(cast(row_number() over (partition by user_id order by ts, event_id) as varchar), cast(greatest(2, length(cast(count(*) over (partition by user_id) as varchar))) as int), '0') as index from events", "events")
def t4_continuous_reindex(events: DataFrame) -> DataFrame:
    rows = events.select("user_id", "event_id", "ts")
    return reindex.reindexed_stream(rows.sparkSession, _arrivals(rows), rows.schema, scratch(rows.sparkSession, "posts"), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "index")


@query("select o_custkey from (select distinct o_custkey from orders) where o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0 group by 1 having count(distinct o_orderstatus) = 3)", "orders")
def t5_skip_completed_units(orders: DataFrame) -> DataFrame:
    expected = orders.select("o_custkey", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("o_orderstatus"))
    return op.unfinished(expected, orders.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderstatus")
