"""Queries of the readers and writers: tables written in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import readers, writers
from tessera.sources.scratch import scratch


@query("""select o_orderkey, 'R$ ' || cast(cast(o_totalprice as decimal(18,2)) as varchar) as valor, o_orderpriority from orders""", "orders")
def s1_read_delimited(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "delimited")
    writers.write_csv(orders.select("o_orderkey", F.concat(F.lit("R$ "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("valor"), "o_orderpriority"), path, ";")
    read = readers.read_delimited(orders.sparkSession, path, "o_orderkey long, valor string, o_orderpriority string")
    return read.where("_corrupt_record is null").drop("_corrupt_record")


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus from orders", "orders")
def s2_read_csv_required_columns(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "csv")
    writers.write_csv(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return readers.read_csv_required_columns(orders.sparkSession, path, ["o_orderkey", "o_orderstatus"])


@query("select l_linenumber as commit_number, l_returnflag || l_linestatus as commit_hash, l_orderkey, l_partkey from lineitem", "lineitem")
def s3_read_snapshots_with_path_columns(lineitem: DataFrame) -> DataFrame:
    path = scratch(lineitem.sparkSession, "snapshots")
    rows = lineitem.select(F.concat_ws("-", "l_linenumber", F.concat("l_returnflag", "l_linestatus")).alias("commit"), "l_orderkey", "l_partkey")
    rows.write.partitionBy("commit").option("header", True).csv(path)
    return readers.read_snapshots(lineitem.sparkSession, path, "l_orderkey long, l_partkey long")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events", "events")
def s4_read_nested_json(events: DataFrame) -> DataFrame:
    path = scratch(events.sparkSession, "json")
    events.select("event_id", F.from_json("props", "k bigint").alias("issue_data")).write.json(path)
    read = readers.read_nested_json(events.sparkSession, path, "event_id long, issue_data struct<k: bigint>", multi_line=False)
    return read.select("event_id", "issue_data.k")


@query("select 'Game ' || p_name as name, cast(p_partkey as varchar) as app_id, case when p_size % 5 = 0 then 0.0 else 1000.0 + p_size end as hours from part where p_size % 7 <> 0", "part")
def s5_read_xml_rows(part: DataFrame) -> DataFrame:
    path = scratch(part.sparkSession, "xml")
    rows = part.select(
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("Game "), "p_name")).alias("name"), F.col("p_partkey").cast("string").alias("appID"),
        F.when(F.col("p_size") % 5 != 0, F.format_number(1000.0 + F.col("p_size"), 1)).alias("hoursOnRecord"),
    )
    rows.write.format("xml").option("rootTag", "games").option("rowTag", "game").save(path)
    return readers.read_xml_games(part.sparkSession, path)


@query("select line, count(*) as n from (select trim(unnest(string_split(text, chr(10))), ' ') as line from documents) where line <> '' group by 1", "documents")
def s6_read_text_files(documents: DataFrame) -> DataFrame:
    path = scratch(documents.sparkSession, "texts")
    documents.select("text").where("text is not null").write.text(path)
    return readers.read_text_lines(documents.sparkSession, path).groupBy("line").agg(F.count("*").alias("n"))


@query("select source || '/' || doc_id || '.' || lang as path, source as dir, doc_id || '.' || lang as name, lang as ext, n_chars as size from documents where lang in ('en', 'de')", "documents")
def s7_scan_file_inventory(documents: DataFrame) -> DataFrame:
    files = documents.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), F.col("n_chars").alias("size"))
    return readers.inventory_of(files, ["en", "de"], ignored_dirs=r"(^|/)\.git(/|$)", ignored_names=r"^~")


@query("select cast(label as double) as label, len(embedding) as n_features, cast(round(cast(embedding[1] as double) * 1000) as bigint) as first_feature from embeddings", "embeddings")
def s8_read_feature_matrix(embeddings: DataFrame) -> DataFrame:
    path = scratch(embeddings.sparkSession, "matrix")
    writers.write_text_lines(embeddings, path, F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")))
    read = readers.read_feature_matrix(embeddings.sparkSession, path)
    return read.select("label", F.size("features").alias("n_features"), (F.get("features", 0).cast("float").cast("double") * 1000).cast("decimal(18,0)").cast("long").alias("first_feature"))


_FATURA = "case when o_orderkey % 3 = 0 then 'Fatura(' || strftime(o_orderdate, '%Y-%m-%d') || ').csv' when o_orderkey % 3 = 1 then 'FATURA(2024-13-45).CSV' else 'extrato.csv' end"


@query(f"with n as (select {_FATURA} as name from orders) select name, case when name like 'Fatura(%' then substr(name, 8, 10) end as file_date, count(*) as n_files from n group by all", "orders")
def s9_select_dated_file(orders: DataFrame) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Fatura("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(").csv"))).when(F.col("o_orderkey") % 3 == 1, "FATURA(2024-13-45).CSV").otherwise("extrato.csv")
    return orders.select(name.alias("name")).groupBy("name", readers.dated_file(F.col("name")).cast("string").alias("file_date")).agg(F.count("*").alias("n_files"))


@query("select c_custkey, c_name, c_mktsegment from customer", "customer")
def k1_write_csv(customer: DataFrame) -> DataFrame:
    path = scratch(customer.sparkSession, "csv")
    writers.write_csv(customer.select("c_custkey", "c_name", "c_mktsegment"), path, ";")
    return customer.sparkSession.read.schema("c_custkey long, c_name string, c_mktsegment string").option("sep", ";").option("header", True).csv(path)


@query("select o_orderpriority, count(*) as n, min(o_orderkey) as first_order from orders group by 1", "orders")
def k2_write_json_report(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "report")
    counted = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    writers.write_json_report(counted, path, ["o_orderpriority"], ["n", "first"], ["o_orderstatus"])
    items = orders.sparkSession.read.schema("o_orderpriority string, place bigint, item struct<o_orderstatus: string, n: bigint, first: bigint>").json(f"{path}/items")
    summary = orders.sparkSession.read.schema("o_orderpriority string, summary struct<n: bigint>").json(f"{path}/summary")
    read = items.groupBy("o_orderpriority").agg(F.sum("item.n").alias("n"), F.min("item.first").alias("first_order"), F.count("*").alias("_items"))
    return read.join(summary.where("summary.n is not null"), "o_orderpriority").where("_items = summary.n").select("o_orderpriority", "n", "first_order")


@query("with f as (select event_type, min(event_id) as first from events group by 1) select e.event_id, row_number_ || '-' || e.event_type as part from events e join (select event_type, row_number() over (order by first, event_type) as row_number_ from f) using (event_type)", "events")
def k3_write_split_by_key(events: DataFrame) -> DataFrame:
    path = scratch(events.sparkSession, "split")
    writers.write_split_by_key(events.select("event_id", "event_type"), path, "event_type", "event_id")
    return events.sparkSession.read.option("header", True).csv(path).select(F.col("event_id").cast("long").alias("event_id"), "part")


@query("select o_orderkey, o_orderstatus from orders", "orders")
def k4_write_simplified(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "simplified")
    writers.write_csv(orders, path, columns=["o_orderkey", "o_orderstatus"])
    return orders.sparkSession.read.schema("o_orderkey long, o_orderstatus string").option("header", True).csv(path)


@query("select 'v' || o_orderkey || ' - ' || o_orderpriority as value from orders", "orders")
def k5_write_text_lines(orders: DataFrame) -> DataFrame:
    path = scratch(orders.sparkSession, "lines")
    writers.write_text_lines(orders, path, F.format_string("v%d - %s", "o_orderkey", "o_orderpriority"))
    return orders.sparkSession.read.text(path)


@query("select l_linenumber || '-' || l_returnflag as commit, count(*) as n_files, count(distinct l_partkey) as n_parts from lineitem group by 1", "lineitem")
def k6_write_diff_partitioned(lineitem: DataFrame) -> DataFrame:
    path = scratch(lineitem.sparkSession, "diffs")
    writers.write_diffs(lineitem.select(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("hash"), F.col("l_partkey").cast("string").alias("file"), F.col("l_shipdate").cast("string").alias("diff")), path)
    read = lineitem.sparkSession.read.text(path).where(F.col("value").startswith("--- "))
    return read.groupBy("commit").agg(F.count("*").alias("n_files"), F.count_distinct("value").alias("n_parts"))
