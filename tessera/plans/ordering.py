"""Queries of sorting, limits and set operations; sorted ones carry their place where it is few rows' work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordering as op
from tessera.plans.registry import query


@query("select p_partkey, p_size from part order by cast(p_size as varchar)", "part")
def o1_sort_by_column_text(part: DataFrame) -> DataFrame:
    return op.sorted_as_text(part, "p_size").select("p_partkey", "p_size")


@query("select l_partkey, count(*) as changes from lineitem group by 1 order by 2 desc, 1", "lineitem")
def o2_sort_desc(lineitem: DataFrame) -> DataFrame:
    return op.sorted_desc(lineitem.groupBy("l_partkey").agg(F.count("*").alias("changes")), "changes", ["l_partkey"])


@query("select c_name || '^{}' as tag, 'customer#' || lpad(cast(c_custkey as varchar), 12, '0') as key from customer", "customer")
def o3_natural_sort(customer: DataFrame) -> DataFrame:
    tags = customer.select(F.concat("c_name", F.lit("^{}")).alias("tag"))
    return op.natural_sort(tags, "tag").select("tag", op.natural_key(F.col("tag")).alias("key"))


@query("select page_id, split_part(url, '/', -1) as segment from pages where split_part(url, '/', -1) not like '% %'", "pages")
def o4_sort_by_last_segment(pages: DataFrame) -> DataFrame:
    return op.by_last_segment(pages, "url").select("page_id", F.substring_index("url", "/", -1).alias("segment"))


@query("select n_nationkey, n_name from nation order by lower(n_name), n_name", "nation")
def o5_case_insensitive_sorts(nation: DataFrame) -> DataFrame:
    return op.case_insensitive(nation, "n_name").select("n_nationkey", "n_name")


@query("select user_id, count(*) as votes from events group by 1 having count(*) >= 60 order by 2 desc, 1 limit 100", "events")
def o6_top_k_by_votes(events: DataFrame) -> DataFrame:
    return op.top_by_votes(events, "user_id", 60, 100)


@query("select o_orderkey from orders order by o_orderkey limit 100", "orders")
def o7_limit_n(orders: DataFrame) -> DataFrame:
    return op.first_n(orders.select("o_orderkey"), "o_orderkey", 100)


@query("with p as (select a.vec_id as query, b.vec_id as other, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query, other, similarity from p where similarity > 0 qualify row_number() over (partition by query order by similarity desc, other) <= 5", "embeddings")
def o8_top_n_similar(embeddings: DataFrame) -> DataFrame:
    return op.top_similar(embeddings, "vec_id", "embedding", embeddings.where("vec_id % 20 = 0"), 5)


@query("select 'customer' as input, c_name as name from customer union all select 'supplier', s_name from supplier", "customer supplier")
def u1_union_inputs(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return op.union_inputs({"customer": customer.select(F.col("c_name").alias("name")), "supplier": supplier.select(F.col("s_name").alias("name"))})


@query("select c_custkey as person from customer intersect select user_id from events", "customer events")
def u2_intersect_names(customer: DataFrame, events: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("person")).intersect(events.select("user_id"))


@query("select c_custkey as person from customer except select user_id from events", "customer events")
def u3_except_names(customer: DataFrame, events: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("person")).subtract(events.select("user_id"))


@query("select user_id, min(event_id) as first, arg_min(event_type, event_id) as event_type from events group by 1", "events")
def u4_distinct_keep_first(events: DataFrame) -> DataFrame:
    return op.distinct_keep_first(events, "user_id", "event_id", "event_type")
