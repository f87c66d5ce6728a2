"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as op
from tessera.operators import filters, sketches
from tessera.operators import windows as win
from tessera.plans.registry import query

DEC = "cast({} as decimal(18,2))"


@query(f"select cast(sum({DEC.format('o_totalprice')}) as double) as total, count(*) as n_rows, count(*) filter (where o_orderpriority = '5-LOW') as cash, count(*) filter (where o_orderpriority <> '5-LOW') as instalments, cast(sum({DEC.format('o_totalprice * 0.01')}) as double) as cashback from orders", "orders")
def a1_bill_summary(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    return orders.agg(
        F.sum(op.money(price)).cast("double").alias("total"), F.count("*").alias("n_rows"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("cash"),
        F.count_if(F.col("o_orderpriority") != "5-LOW").alias("instalments"), F.sum(op.money(price * 0.01)).cast("double").alias("cashback"),
    )


@query("select p_name, count(*) as n, min(p_partkey) as representative, array_to_string(list_sort(list(p_partkey)), ',') as members from part group by 1 having count(*) > 1", "part")
def a2_duplicate_groups(part: DataFrame) -> DataFrame:
    return op.duplicate_groups(part, "p_name", "p_partkey")


@query("select p_name, row_number() over (partition by p_name order by p_partkey) as place, p_partkey from part qualify count(*) over (partition by p_name) > 1", "part")
def a2_duplicate_members(part: DataFrame) -> DataFrame:
    return op.duplicate_members(part, ["p_name"], "p_partkey")


@query("select array_to_string(list_slice(string_split(url, '/'), 3, len(string_split(url, '/')) - 1), '/') as directory, count(*) as n from pages group by 1 having count(*) > 1", "pages")
def a3_repeated_url_directories(pages: DataFrame) -> DataFrame:
    return op.repeated_directories(pages, "url")


@query("""select lower(split_part(text, chr(10), 1)) as title, lang, count(*) as occurrences, count(distinct source) as places, array_to_string(list_sort(list(distinct source)), ',') as variants,
          arg_min(t, (length(t), lower(t), t)) as representative from (select *, split_part(text, ' ', 1) as t from documents) group by 1, 2""", "documents")
def a4_duplicate_group_report(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.lower(F.substring_index("text", "\n", 1)).alias("title"), "lang", "source", F.substring_index("text", " ", 1).alias("t"))
    return op.group_report(rows, ["title", "lang"], "source", "source", "t").withColumn("variants", F.array_join("variants", ","))


@query("""with i as (select c_custkey as person, 1 as ordinal, 'customer' as source from customer union all select o_custkey, 2, 'order' from orders union all select user_id, 3, 'event' from events)
          select person, case when count(distinct source) = 3 then 'customer+order+event' when bool_or(ordinal = 1) and bool_or(ordinal = 2) then 'customer+order'
          when bool_or(ordinal = 1) then 'customer+event' else 'order+event' end as scope, count(*) as n from i group by 1 having count(distinct source) >= 2""", "customer orders events")
def a5_cross_input_groups(customer: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    one = lambda d, c, n, s: d.select(F.col(c).alias("person"), F.lit(n).alias("ordinal"), F.lit(s).alias("source"))
    rows = one(customer, "c_custkey", 1, "customer").union(one(orders, "o_custkey", 2, "order")).union(one(events, "user_id", 3, "event"))
    return op.cross_input_groups(rows, "person", "source", "ordinal")


@query("select p_name, count(*) as n, count(distinct (p_size, p_type)) as n_variants from part group by 1 having count(*) > 1 and count(distinct (p_size, p_type)) > 1", "part")
def a6_variant_duplicates(part: DataFrame) -> DataFrame:
    return op.variant_duplicates(part, "p_name", ["p_size", "p_type"])


_STATS = "select l_partkey, count(*) as changes, round(min(l_quantity), 3) as low, round(max(l_quantity), 3) as high, round(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*), 3) as mean, round(quantile_cont(l_quantity, 0.75), 3) as q3, arg_min(l_linenumber, (l_orderkey, l_linenumber, l_quantity)) as first_commit, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_quantity)) as last_commit from lineitem group by 1 having count(*) >= 10"


@query(_STATS, "lineitem")
def a7_metric_statistics(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.withColumn("_o", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    out = op.metric_statistics(rows, ["l_partkey"], "l_quantity", "_o", "l_linenumber", 10)
    return out


@query("select user_id, row_number() over (partition by user_id order by event_id) as place, event_id, event_type, count(*) over (partition by user_id) as changes from events", "events")
def a8_change_history(events: DataFrame) -> DataFrame:
    return op.change_history(events, "user_id", "event_id", ["event_type"])


@query("select user_id, n, round(slope, 4) + 0.0 as slope, round(intercept, 4) as intercept from (select user_id, count(*) as n, regr_slope(value, x) as slope, regr_intercept(value, x) as intercept from (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as x from events) group by 1) where n >= 2", "events")
def a9_linear_trend(events: DataFrame) -> DataFrame:
    return op.linear_trend(events, "user_id", ["event_id"], "value").select("user_id", "n", (F.round("slope", 4) + F.lit(0.0)).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""with t as (select unnest(case when len(m) > 0 then list_distinct(m) when p_size > 0 then ['none'] end) as category, p_retailprice, p_brand from (select *, regexp_extract_all(p_name, '(red|blue|ring|bolt)') as m from part))
          select category, count(*) as n, cast(sum(cast(p_retailprice as decimal(18,2))) as double) as total, array_to_string(list_sort(list(distinct p_brand)), ',') as items from t group by 1""", "part")
def a10_category_report(part: DataFrame) -> DataFrame:
    return op.category_report(part, "p_name", "(red|blue|ring|bolt)", "p_retailprice", "p_brand").withColumn("items", F.array_join("items", ","))


@query("select l_linestatus, count(*) filter (where l_returnflag = 'R') as owned, count(*) as total, round(count(*) filter (where l_returnflag = 'R') * 100.0 / count(*), 2) as percent from lineitem group by 1", "lineitem")
def a11_collection_counters(lineitem: DataFrame) -> DataFrame:
    return op.collection_counters(lineitem, "l_linestatus", F.col("l_returnflag") == "R")


@query("select event_type, n from (select event_type, count(*) as n, min(event_id) as f from events group by 1) order by n desc, f limit 1", "events")
def a12_most_common_value(events: DataFrame) -> DataFrame:
    return op.most_common(events, "event_type", "event_id")


@query("""with u as (select vec_id, [x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])) for x in embedding] as v from embeddings), p as (select list_inner_product(a.v, b.v) as c from u a join u b on a.vec_id < b.vec_id)
          select count(*) as n_pairs, round(avg(c), 4) as mean, round(avg(c) - 1.96 * stddev_samp(c) / sqrt(count(*)), 3) + 0.0 as low, round(avg(c) + 1.96 * stddev_samp(c) / sqrt(count(*)), 3) as high from p""", "embeddings")
def a13_pairwise_similarity_ci(embeddings: DataFrame) -> DataFrame:
    return op.similarity_interval(embeddings, "embedding", 64).select("n_pairs", F.round("mean", 4).alias("mean"), (F.round("low", 3) + F.lit(0.0)).alias("low"), F.round("high", 3).alias("high"))


#: All pairs of texts in plain SQL: what the query does without pairs.
_TEXT_PAIRS = f"""
with k as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{sketches.TERM}')) as term from documents),
t as (select doc_id, term, count(*) as tf from k group by all), d as (select term, count(*) as df from t group by 1), s as (select count(*) as n from documents),
w as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from t join d using (term), s),
u as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as u from w),
p as (select a.doc_id, b.doc_id as other, sum(a.u * b.u) as c from u a join u b on a.term = b.term and a.doc_id < b.doc_id group by all),
m as (select n * (n - 1) // 2 as n_pairs, (select sum(c) from p) / n_pairs as mean, (select sum(c * c) from p) as q from s),
h as (select n_pairs, mean, 1.96 * sqrt((q - n_pairs * mean * mean) / (n_pairs - 1)) / sqrt(n_pairs) as half from m)
select cast(n_pairs as bigint) as n_pairs, round(mean, 4) as mean, round(mean - half, 3) as low, round(mean + half, 3) as high from h"""


@query(_TEXT_PAIRS, "documents")
def a13_text_similarity_ci(documents: DataFrame) -> DataFrame:
    found = sketches.text_similarity(documents, "text")
    return found.select("n_pairs", F.round("mean", 4).alias("mean"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("select quality, count(*) filter (where doc_id % 4 <> 0) as train, count(*) filter (where doc_id % 4 = 0) as test, count(*) filter (where doc_id % 4 <> 0) = count(*) filter (where doc_id % 4 = 0) as equal from labels group by 1", "labels")
def a14_class_balance(labels: DataFrame) -> DataFrame:
    return op.class_balance(labels.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")), "quality", "split")


@query("""with p as (select string_split(url, '/') as s, length(html) as size from pages), e as (select array_to_string(s[1:i], '/') as directory, size from (select s, size, unnest(range(1, len(s))) as i from p))
          select directory, cast(sum(size) as bigint) as bytes, round(cast(sum(size) as double) / (1024.0 * 1024 * 1024), 2) as gb from e group by 1""", "pages")
def a15_directory_size_rollup(pages: DataFrame) -> DataFrame:
    return op.directory_sizes(pages.select("url", F.length("html").cast("long").alias("size")), "url", "size")


@query("select split_part(replace(url, '://', '_'), '/', 1) as top, cast(sum(length(html)) as bigint) as bytes from pages where split_part(replace(url, '://', '_'), '/', 1) <> 'http_tionsh.example.net' group by 1", "pages")
def a16_top_level_dir_sizes(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.replace("url", F.lit("://"), F.lit("_")).alias("path"), F.length("html").cast("long").alias("size"))
    return op.top_level_sizes(rows, "path", "size", ["http_tionsh.example.net"])


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' group by 1 having sum(case when o_totalprice > 100000 then 1 else 0 end) > 0)", "customer orders")
def a17_empty_directories(customer: DataFrame, orders: DataFrame) -> DataFrame:
    files = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("size"))
    return op.empty_directories(customer, files, "c_custkey", "size")


@query("select c_nationkey, row_number() over (partition by c_nationkey order by c_mktsegment) as place, c_mktsegment, count(*) over (partition by c_nationkey) as n from (select distinct c_nationkey, c_mktsegment from customer where c_mktsegment is not null)", "customer")
def a18_distinct_sorted_per_group(customer: DataFrame) -> DataFrame:
    return op.sorted_values(customer, "c_nationkey", "c_mktsegment")


@query("select o_orderpriority, cast((rn - 1) // 50 as bigint) as batch, '!addlicense a/' || string_agg(o_orderkey, ', a/' order by o_orderkey) as command from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) group by 1, 2", "orders")
def a19_batched_command_strings(orders: DataFrame) -> DataFrame:
    return op.command_batches(orders, "o_orderpriority", "o_orderkey", "!addlicense a/")


@query("select case when n_chars = 0 then 'empty' when lang = 'en' then 'skip' else 'translate' end as status, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by 1", "documents")
def a20_plan_summary(documents: DataFrame) -> DataFrame:
    status = F.when(F.col("n_chars") == 0, "empty").when(F.col("lang") == "en", "skip").otherwise("translate")
    return documents.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""with r as (select user_id, count(*) filter (where event_type <> 'signup') as scanned, count(*) filter (where event_type not in ('signup', 'error')) as clean, count(*) filter (where event_type = 'error') as corrupt, count(*) filter (where event_type = 'signup') as failed from events group by 1)
          select *, least(corrupt, 10) as error_lines, corrupt > 10 as truncated from r""", "events")
def a21_scan_status_rollup(events: DataFrame) -> DataFrame:
    return op.scan_rollup(events, "user_id", F.col("event_type") == "signup", F.col("event_type") == "error", "event_id", 10)


@query("select event_type, cast(sum(event_id) as bigint) as bytes, cast(floor(epoch(max(ts) - min(ts))) as bigint) as seconds, case when floor(epoch(max(ts) - min(ts))) > 0 then round(sum(event_id) / floor(epoch(max(ts) - min(ts))), 4) end as rate from events group by 1", "events")
def a22_throughput_summary(events: DataFrame) -> DataFrame:
    return op.throughput(events, "event_type", "event_id", "ts", "ts")


@query("select l_returnflag, l_linestatus, l_linenumber, count(*) as n, sum(cast(l_quantity as bigint))::bigint as total from lineitem group by cube (l_returnflag, l_linestatus, l_linenumber) having grouping_id(l_returnflag, l_linestatus, l_linenumber) < 7", "lineitem")
def a23_attribute_subset_aggregate(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return op.subset_aggregates(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")


@query("""with g as (select l_partkey, l_quantity, count(distinct l_suppkey) as sources, min(l_suppkey) as s from lineitem group by 1, 2), b as (select l_partkey, count(*) as k, arg_min(l_quantity, (-sources, s, l_quantity)) as v, arg_min(sources, (-sources, s, l_quantity)) as sources from g group by 1)
          select l_partkey, case when sources >= 2 then v end as l_quantity, sources, case when k = 1 then 'same' else 'different' end as report from b""", "lineitem")
def a24_agreeing_sources(lineitem: DataFrame) -> DataFrame:
    return op.agreeing_sources(lineitem, "l_partkey", "l_quantity", "l_suppkey")


@query("select l as library, count(distinct 'f' || (p_partkey // 40)) as files, array_to_string(list_sort(list(distinct 'f' || (p_partkey // 40))), ',') as paths from part, (select unnest(['math', 'os']) as l) group by 1", "part")
def a25_library_import_inventory(part: DataFrame) -> DataFrame:
    from tessera.functions.tables import source_symbols
    from tessera.plans.joins import _sources

    return op.import_inventory(source_symbols(_sources(part))).withColumn("paths", F.array_join("paths", ","))


@query("""with t as (select p_brand, case when p_type not in ('SMALL', 'ECONOMY', 'LARGE') then 'unfound' when p_type = case when p_size % 2 = 0 then 'SMALL' else 'ECONOMY' end then 'correct' else 'misplaced' end as status from part)
          select p_brand, count(*) filter (where status = 'correct') as correct, count(*) filter (where status = 'misplaced') as misplaced, count(*) filter (where status = 'unfound') as unfound, count(*) filter (where status <> 'correct') as issues from t group by 1""", "part")
def a26_misplacement_summary(part: DataFrame) -> DataFrame:
    folder = F.when(F.col("p_size") % 2 == 0, "SMALL").otherwise("ECONOMY")
    found = F.when(F.col("p_type").isin("SMALL", "ECONOMY", "LARGE"), F.col("p_type"))
    return op.status_totals(part.withColumn("status", filters.placement(found, folder)), "p_brand", "status", ["correct", "misplaced", "unfound"])


@query("""with d as (select l_orderkey, arg_min(l_returnflag, (l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey)) as flag, count(*) as tracks from lineitem group by 1)
          select l_orderkey, flag, tracks, case when flag = 'A' then 'unknown' else 'other' end as bucket from d where flag <> 'R'""", "lineitem")
def a27_non_default_language_report(lineitem: DataFrame) -> DataFrame:
    picked = win.priority_pick(lineitem, "l_orderkey", "l_returnflag", ["R"], ["l_linenumber", "l_partkey", "l_suppkey"])
    tracks = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("tracks"))
    out = picked.select("l_orderkey", F.col("l_returnflag").alias("flag")).where("flag <> 'R'").join(tracks, "l_orderkey")
    return out.withColumn("bucket", F.when(F.col("flag") == "A", "unknown").otherwise("other"))


_SAMPLE = r"""with l as (select doc_id, pos, trim(line) as line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
          k as (select *, row_number() over (partition by doc_id, lower(line) order by pos) as r from l where regexp_matches(line, '[A-Za-z].*[A-Za-z].*[A-Za-z]')),
          c as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from k where r <= 3)"""


@query(_SAMPLE + " select doc_id, string_agg(line, chr(10) order by pos) as sample, count(*) as n_lines from c where before < 4000 group by 1", "documents")
def a28_contiguous_line_sample(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]"))
    kept = win.capped_sample(lines, "doc_id", "pos", "line", 3, 4000)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("sample"), F.count("*").alias("n_lines"))
