"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters as op
from tessera.operators.numbering import numbered
from tessera.plans.registry import query


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus is null or o_orderstatus not in ('F', 'X')", "orders")
def f1_exclude_by_value(orders: DataFrame) -> DataFrame:
    return op.exclude_values(orders, "o_orderstatus", ["F", "X"]).select("o_orderkey", "o_orderstatus")


@query("select row_number() over (order by p_partkey) as number, p_partkey, p_size from part where p_size < 12.1", "part")
def f2_filter_below_and_renumber(part: DataFrame) -> DataFrame:
    return op.below_renumbered(part, "p_size", 12.1, "p_partkey").select(F.col("number").cast("long").alias("number"), "p_partkey", "p_size")


@query(r"select page_id, url from pages where (regexp_matches(lower(url), '^.*/en/.*$', 's') or regexp_matches(lower(url), '^.*\.html$', 's')) and not regexp_matches(lower(url), '^.*utm_.*$', 's')", "pages")
def f3_glob_track_ignore(pages: DataFrame) -> DataFrame:
    return pages.where(op.should_track(F.col("url"), ["*/EN/*", "*.html"], ["*utm_*"])).select("page_id", "url")


@query("select doc_id from documents where contains(text, ' the ') and not contains(text, ' der ')", "documents")
def f4_contains_and_not_contains(documents: DataFrame) -> DataFrame:
    return documents.where(op.contains_but_not(F.col("text"), " the ", " der ")).select("doc_id")


@query("select page_id, row_number() over (order by page_id) as number from pages where not contains(split_part(url, '/', -1), '.') and not regexp_matches(lower(url), '/(de|fr)/')", "pages")
def f5_no_extension_filter(pages: DataFrame) -> DataFrame:
    return numbered(pages.where(op.without_extension(F.col("url"), "/(de|fr)/")).select("page_id"), ["page_id"])


@query(r"select doc_id, regexp_matches(text, '\(\d+\)') or contains(text, 'copy') as is_copy from documents", "documents")
def f6_copy_name_filter(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", op.is_copy_name(F.col("text")).alias("is_copy"))


@query(r"with p as (select page_id, split_part(split_part(url, '?', 1), '#', 1) as path from pages) select page_id, path from p where (lower(regexp_extract(split_part(path, '/', -1), '\.([A-Za-z0-9]+)$', 1)) in ('html', 'exe') or split_part(path, '/', -1) in ('robots.txt')) and not regexp_matches(path, '/fr/')", "pages")
def f7_select_by_extension_or_name(pages: DataFrame) -> DataFrame:
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return pages.select("page_id", path.alias("path")).where(op.removal_candidate(F.col("path"), ["html", "exe"], ["robots.txt"], "/fr/"))


@query(r"select doc_id from documents where not regexp_matches(text, '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])')", "documents")
def f8_missing_year_filter(documents: DataFrame) -> DataFrame:
    return documents.where(~op.has_year(F.col("text"))).select("doc_id")


@query("""with t as (select p_partkey, p_type, case when contains(lower(p_type), 'economy') then 'ECONOMY' when contains(lower(p_type), 'small') then 'SMALL' when contains(lower(p_type), 'large') then 'LARGE' end as found,
          case when p_size % 2 = 0 then 'SMALL' else 'ECONOMY' end as folder from part)
          select p_partkey, found, case when found is null then 'unfound' when found = folder then 'correct' else 'misplaced' end as status from t""", "part")
def f9_classify_placement(part: DataFrame) -> DataFrame:
    folder = F.when(F.col("p_size") % 2 == 0, "SMALL").otherwise("ECONOMY")
    found = op.first_tag(F.col("p_type"), ["ECONOMY", "SMALL", "LARGE"])
    return part.select("p_partkey", found.alias("found"), op.placement(found, folder).alias("status"))


@query("select doc_id from documents where n_chars = 0 or length(text) - 100 <= 0 or n_chars % 7 <= 0", "documents")
def f10_metadata_health_filter(documents: DataFrame) -> DataFrame:
    return documents.where(op.unhealthy(F.col("n_chars"), F.length("text") - 100, F.col("n_chars") % 7)).select("doc_id")


@query("""with n as (select case when doc_id % 9 = 0 then '.' || source when doc_id % 9 = 1 then 'Thumbs.db' else source end as name, n_chars from documents)
          select count(*) as n_files, cast(sum(n_chars) as bigint) as total_size, count(*) filter (where (name like '.%' or lower(name) in ('thumbs.db')) and n_chars > 0) as n_suspicious from n""", "documents")
def f11_suspicious_filter(documents: DataFrame) -> DataFrame:
    name = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("."), "source")).when(F.col("doc_id") % 9 == 1, "Thumbs.db").otherwise(F.col("source"))
    flag = op.suspicious(name, F.col("n_chars"), ["thumbs.db", "desktop.ini"])
    return documents.agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("total_size"), F.count_if(flag).alias("n_suspicious"))


@query("select event_id from events where ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-20' + interval 1 day", "events")
def f12_plausible_time_filter(events: DataFrame) -> DataFrame:
    return events.where(op.plausible_time(F.col("ts"), "2024-01-03", "2024-01-20")).select("event_id")


@query("select p_partkey, p_name from part where not contains(lower(p_name), 'red') and not contains(lower(p_name), 'bolt') and not contains(lower(p_type), 'red') and not contains(lower(p_type), 'bolt')", "part")
def f13_ignore_keywords(part: DataFrame) -> DataFrame:
    return part.where(op.without_keywords([F.col("p_name"), F.col("p_type")], ["RED", "bolt"])).select("p_partkey", "p_name")


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag in ('A', 'R')", "lineitem")
def f14_valid_type_filter(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_returnflag")


_REQUIRED = ["Ouwhea the of rend and threlyes ofthstthor nd of ouble edoution wh onharent.", "Zu und. Dieüauß der.", "Anble anes."]


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), r as (select unnest([" + ", ".join(f"'{x}'" for x in _REQUIRED) + "]) as line) select d.doc_id, r.line from (select distinct doc_id from l) d, r where not exists (select 1 from l where l.doc_id = d.doc_id and l.line = r.line)", "documents")
def f15_missing_required_lines(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return op.missing_lines(lines, "doc_id", "line", _REQUIRED)


@query("select event_id, array_to_string(list_filter(['k', 'user', 'k\": 1'], lambda f: not contains(lower(props), f)), ',') as missing from events", "events")
def f16_missing_fields(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.array_join(op.missing_fields(F.col("props"), ["k", "user", 'k": 1']), ",").alias("missing"))


@query(r"""with p as (select page_id, case when page_id % 2 = 0 then 'a.B' else 'B' end as name, replace(url, '/en/', '/src/') || '/x.java' as path from pages)
          select page_id, (case when contains(name, '.') then name else replace(regexp_extract(path, '/src/(.*)\.[^.]*$', 1), '/', '.') end) || ' ' || 'method' as identifier from p""", "pages")
def f17_class_name_validity_and_identifier(pages: DataFrame) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, "a.B").otherwise("B")
    path = F.concat(F.replace("url", F.lit("/en/"), F.lit("/src/")), F.lit("/x.java"))
    return pages.select("page_id", F.concat_ws(" ", op.class_name(name, path), F.lit("method")).alias("identifier"))


@query("select event_id, event_type = 'signup' or cast(json_extract(props, '$.k') as int) % 10 = 1 or contains(event_type, 'err') as flagged from events", "events")
def f18_stream_flag_predicates(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    disposition = F.create_map(F.lit("forced"), F.when(k % 10 == 1, "1").otherwise("0"))
    tags = F.create_map(F.lit("title"), F.when(F.col("event_type") == "signup", "Forced").otherwise("main"))
    return events.select("event_id", op.stream_flagged(disposition, "forced", [F.col("event_type")], tags, ["forced", "err"]).alias("flagged"))
