"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import windows as op
from tessera.operators.aggregates import money
from tessera.plans.registry import query

_RUN = "with r as (select o_custkey, o_orderkey, o_orderdate, cast(floor(o_totalprice / 100) as decimal(18,2)) as v, sum(cast(floor(o_totalprice / 100) as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as running from orders)"


def _running(orders: DataFrame) -> DataFrame:
    rows = orders.withColumn("v", money(F.floor(F.col("o_totalprice") / 100)))
    return op.running_total(rows, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("v"))


@query(_RUN + " select o_custkey, o_orderkey, cast(running as double) as running from r", "orders")
def w1_running_total(orders: DataFrame) -> DataFrame:
    return _running(orders).select("o_custkey", "o_orderkey", F.col("running").cast("double").alias("running"))


@query(_RUN + ", t as (select *, case when running <= 1500 then 0.000 when running <= 3000 then 0.005 when running <= 7500 then 0.010 else 0.011 end::decimal(4,3) as rate from r), c as (select *, round(v * rate, 2) as cashback from t) select o_custkey, o_orderkey, cast(rate as double) as rate, cast(cashback as double) as cashback, cast(sum(cashback) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as double) as running_cashback from c", "orders")
def w2_tiered_rate_on_running_total(orders: DataFrame) -> DataFrame:
    rated = _running(orders).withColumn("rate", op.tiered_rate(F.col("running")))
    rated = rated.withColumn("cashback", F.round(F.col("v") * F.col("rate"), 2))
    out = op.running_total(rated, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("cashback"), "running_cashback")
    return out.select("o_custkey", "o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("rate", "cashback", "running_cashback")])


@query("select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as day, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey desc) as place from orders", "orders")
def w3_date_asc_original_desc(orders: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.asc("o_orderdate"), F.desc("o_orderkey")))
    return orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), place.cast("long").alias("place"))


@query("""with b as (select user_id, event_id, value as "to", lag(value) over (partition by user_id order by event_id) as "from", lag(event_id) over (partition by user_id order by event_id) as previous from events),
          d as (select *, round(("from" - "to") / "from", 3) as "drop" from b where "from" <> 0) select user_id, "from", "to", "drop", event_id, previous from d where "drop" > 0.2 qualify row_number() over (partition by user_id order by "drop" desc, event_id) = 1""", "events")
def w4_largest_relative_drop(events: DataFrame) -> DataFrame:
    return op.largest_drop(events, "user_id", "event_id", "value")


@query("select user_id, event_id, lead(event_id) over w as \"end\", lpad(cast(row_number() over w as varchar), cast(greatest(2, length(cast(row_number() over w as varchar))) as int), '0') as name from events window w as (partition by user_id order by event_id)", "events")
def w5_segment_ends(events: DataFrame) -> DataFrame:
    return op.segment_ends(events, "user_id", "event_id").select("user_id", "event_id", "end", "name")


@query("""with n as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as n from events), p as (select user_id, n // 2 as p, arg_min(value, n) as start, arg_max(value, n) as "end" from n group by 1, 2 having count(*) = 2),
          v as (select *, max("end") over (partition by user_id order by p rows between unbounded preceding and 1 preceding) as b from p where start < "end") select user_id, greatest(start, coalesce(b, start)) as start, "end" from v where greatest(start, coalesce(b, start)) < "end" """, "events")
def w6_paired_non_overlapping_intervals(events: DataFrame) -> DataFrame:
    return op.paired_intervals(events, "user_id", "event_id", "value")


@query("""with r as (select user_id, event_id, event_type, cast(json_extract(props, '$.k') as int) as k, case event_type when 'purchase' then 0 when 'click' then 1 else 9 end as rank from events),
          o as (select * from r qualify row_number() over (partition by user_id, k order by rank, event_id) = 1) select user_id, event_id from o qualify row_number() over (partition by user_id order by rank, event_id) <= 20""", "events")
def w7_keep_first_by_priority_capped(events: DataFrame) -> DataFrame:
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return op.first_by_priority(rows, "user_id", ["k"], "event_type", ["purchase", "click"], "event_id", 20).select("user_id", "event_id")


@query("select l_orderkey, arg_min(l_returnflag, (case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_linenumber, l_partkey, l_suppkey)) as l_returnflag, arg_min(l_linenumber, (case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_linenumber, l_partkey, l_suppkey)) as l_linenumber from lineitem group by 1", "lineitem")
def w8_priority_pick(lineitem: DataFrame) -> DataFrame:
    return op.priority_pick(lineitem, "l_orderkey", "l_returnflag", ["R", "A"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_returnflag", "l_linenumber")


@query("select l_orderkey, l_returnflag, l_partkey, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as type_position from lineitem", "lineitem")
def w9_type_relative_position(lineitem: DataFrame) -> DataFrame:
    return op.relative_position(lineitem, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_returnflag", "l_partkey", "type_position")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
           h as (select *, nullif(regexp_extract(line, '^(\S+)\.$', 1), '') as h from l), f as (select *, last_value(h ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as section from h)
           select doc_id, pos, section from f where h is null and line <> ''""", "documents")
def w10_section_forward_fill(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return op.section_fill(lines, "doc_id", "pos", "line", r"^(\S+)\.$", [""]).select("doc_id", F.col("pos").cast("long").alias("pos"), "section")


@query("select user_id, event_id from (select user_id, event_id, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by event_id) - 1 as r from events) where n <= 60 or r % 12 = 0", "events")
def w11_downsample_every_k(events: DataFrame) -> DataFrame:
    return op.downsampled(events, "user_id", "event_id", 12, 60).select("user_id", "event_id")


@query("with f as (select user_id, event_type, min(event_id) as f from events group by 1, 2), o as (select user_id, event_type, row_number() over (partition by user_id order by f, event_type) as ordinal from f) select e.event_id, o.ordinal from events e join o using (user_id, event_type)", "events")
def w12_first_appearance_ordinal(events: DataFrame) -> DataFrame:
    return op.first_appearance(events, "user_id", "event_type", "event_id").select("event_id", "ordinal")


@query("select p_partkey, case when n = 0 then p_name else p_name || ' (' || n || ')' end as target from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)", "part")
def w13_collision_suffix(part: DataFrame) -> DataFrame:
    return op.collision_suffix(part, "p_name", "p_partkey").select("p_partkey", "target")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), k as (select * from l qualify row_number() over (partition by doc_id, lower(line) order by pos) <= 3)
          select doc_id, pos from (select doc_id, pos, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as b from k) where b < 1000""", "documents")
def w14_capped_repeat_sample(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return op.capped_sample(lines, "doc_id", "pos", "line", 3, 1000).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) || '. ' || doc_id || ' ' || printf('%.2f', n_chars * 1000000.0 / (1024.0 * 1024 * 1024)) || 'GB' as ranked from documents", "documents")
def w15_rank_by_size_index_name(documents: DataFrame) -> DataFrame:
    rows = documents.select("source", "doc_id", (F.col("n_chars") * 1000000).alias("size"))
    return op.size_ranked_names(rows, "source", "doc_id", "size").select("source", "doc_id", F.col("ranked"))


@query("select user_id, event_id, lpad(cast(row_number() over (partition by user_id order by case when event_id % 10 <> 0 then ts end nulls last, event_id) as varchar), cast(greatest(2, length(cast(count(*) over (partition by user_id) as varchar))) as int), '0') as index from events", "events")
def w16_chronological_reindex(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return op.chronological_index(rows, "user_id", "ts", ["event_id"]).select("user_id", "event_id", "index")


@query("select user_id, event_id, round(cast(m as double), 4) as mean from (select user_id, event_id, count(*) over w as k, sum(cast(value as decimal(18,2))) over w / 5.0 as m from events window w as (partition by user_id order by event_id rows between current row and 4 following)) where k = 5 and m >= 60", "events")
def w17_rolling_mean_threshold(events: DataFrame) -> DataFrame:
    found = op.rolling_mean(events, "user_id", "event_id", money(F.col("value")), 5)
    return found.where("mean >= 60").select("user_id", "event_id", F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query("""with f as (select user_id, event_id, coalesce(cast(event_id - lag(event_id) over (partition by user_id order by event_id) - 1 > 60 as int), 0) as f from events), g as (select *, sum(f) over (partition by user_id order by event_id rows unbounded preceding) as island from f)
          select user_id, min(event_id) as first, max(event_id) as last, count(*) as n from g group by user_id, island""", "events")
def w18_gaps_and_islands(events: DataFrame) -> DataFrame:
    return op.islands(events, "user_id", "event_id", 60)


@query("select o_orderkey, case when o_orderstatus = 'P' then 'Unknown' else o_orderstatus end as owner, row_number() over (partition by o_custkey order by o_orderkey) as number from orders", "orders")
def w19_header_numbering(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("owner"))
    return op.numbered_with_defaults(rows, "o_custkey", "o_orderkey", {"owner": "Unknown"}).select("o_orderkey", "owner", "number")
