"""Queries of the column and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import tables as tx
from tessera.functions import text as fx
from tessera.plans.registry import query

D = "cast(o_totalprice as decimal(18,2))"


@query(f"select o_orderkey, cast({D} as double) as price from orders", "orders")
def x1_parse_brl_money(orders: DataFrame) -> DataFrame:
    english = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    brl = F.concat(F.lit("R$ "), F.translate(english, ",.", ".,"))
    return orders.select("o_orderkey", fx.brl_money(brl).cast("double").alias("price"))


@query("select doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', ' ')), '[^a-z0-9]+', ' ', 'g')) as title from documents", "documents")
def x2_normalize_title(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fx.normalized_title(F.col("text")).alias("title"))


@query("select p_partkey, case when p_size % 2 = 0 then p_name else '12 ' || p_size end as name from part", "part")
def x3_strip_trailing_index(part: DataFrame) -> DataFrame:
    name = F.concat(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("12"), F.lit(" "), "p_size")
    return part.select("p_partkey", fx.without_trailing_index(name).alias("name"))


@query("select doc_id, left(regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g'), 100) as name from documents", "documents")
def x4_sanitize_name(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fx.sanitized(F.col("text")).alias("name"))


@query("select p_partkey, 'Artist s' || p_size as artist, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) as song from part", "part")
def x5_clean_song_name(part: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("Artist $"), "p_size", F.lit(" - "), "p_name", F.lit(" (feat. X) [HD] 1999 - Remastered 2011"))
    both = fx.artist_and_title(raw)
    return part.select("p_partkey", F.replace(both["artist"], F.lit("$"), F.lit("s")).alias("artist"), fx.clean_song(both["title"]).alias("song"))


@query("select p_partkey, p_name || ' ' || case p_size % 3 when 0 then '2160p' when 1 then '1080p' else '4320p' end || ' Dual' as name from part", "part")
def x6_standardize_tokens(part: DataFrame) -> DataFrame:
    size = F.col("p_size") % 3
    name = F.concat("p_name", F.lit(" "), F.when(size == 0, "4K").when(size == 1, "1080P").otherwise("8k"), F.lit(" DUAL"))
    return part.select("p_partkey", fx.standardized_tokens(name).alias("name"))


@query("select p_partkey, case when p_size % 4 > 0 then p_name end as title, case when p_size % 4 > 0 then 1950 + p_size end as year, case when p_size % 4 > 0 then '1080p' end as resolution, case when p_size % 4 = 1 then 'Dual' end as language from part", "part")
def x7_parse_release_name(part: DataFrame) -> DataFrame:
    size = F.col("p_size") % 4
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(size > 0, F.concat(F.lit(".("), 1950 + F.col("p_size"), F.lit(").1080P"))).otherwise(""), F.when(size == 1, ".Dual").otherwise(""))
    return part.select("p_partkey", fx.release_parts(name).alias("r")).select("p_partkey", "r.title", "r.year", "r.resolution", "r.language")


@query("select p_partkey, case when p_size % 4 < 3 then lpad(cast(p_size as varchar), 2, '0') end as season, case when p_size % 4 in (0, 3) then lpad(cast(p_partkey % 90 as varchar), 2, '0') end as episode from part", "part")
def x8_parse_season_episode(part: DataFrame) -> DataFrame:
    k, e = F.col("p_size") % 4, (F.col("p_partkey") % 90).cast("string")
    name = F.when(k == 0, F.concat(F.lit("Show.s"), "p_size", F.lit("e"), e)).when(k == 1, F.concat(F.lit("Season "), "p_size")).when(k == 2, F.concat(F.lit("Series.S"), "p_size", F.lit(".1080p"))).otherwise(e)
    both = fx.season_episode(name)
    return part.select("p_partkey", both["season"].alias("season"), both["episode"].alias("episode"))


@query("select p_partkey, case p_size % 3 when 0 then 1440 when 1 then 2160 else 720 end as resolution, case when p_size * 50 >= 2160 then 2160 when p_size * 50 >= 1080 then 1080 when p_size * 50 >= 720 then 720 else 480 end as bucket from part", "part")
def x9_resolution_normalize_and_order(part: DataFrame) -> DataFrame:
    k = F.col("p_size") % 3
    return part.select("p_partkey", fx.resolution_order(F.when(k == 0, "2K").when(k == 1, "4k").otherwise("720P")).alias("resolution"), fx.height_bucket(F.col("p_size") * 50).alias("bucket"))


@query("select p_partkey, case p_size % 5 when 0 then 'Add Year' when 1 then 'Correct Resolution' when 2 then 'Remove Duplicate Tokens' when 3 then 'Reorder Tokens' else 'Standardize Casing' end as change from part", "part")
def x10_describe_name_change(part: DataFrame) -> DataFrame:
    k, name = F.col("p_size") % 5, F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.lit("x"), F.lit("720p"))
    new = F.when(k == 0, F.concat(name, F.lit(" 1999"))).when(k == 1, F.replace(name, F.lit("720p"), F.lit("1080p"))).when(k == 2, name).when(k == 3, F.concat_ws(" ", F.lit("x"), F.substring_index("p_name", " ", 1), F.lit("720p"))).otherwise(F.upper(name))
    old = F.when(k == 2, F.concat(name, F.lit(" x"))).otherwise(name)
    return part.select("p_partkey", fx.name_change(old, new).alias("change"))


@query("select p_partkey, split_part(p_name, ' ', 1) || case when p_size % 2 = 0 then ' 1080p HDR ' else ' 1999 HDR ' end || split_part(p_name, ' ', 2) as name from part", "part")
def x11_reposition_special_tokens(part: DataFrame) -> DataFrame:
    name = F.concat(F.lit("HDR "), F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 2 == 0, " 1080p ").otherwise(" 1999 "), F.substring_index("p_name", " ", -1))
    return part.select("p_partkey", fx.repositioned_tokens(name).alias("name"))


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?&]+$', '') as url from pages", "pages")
def x12_normalize_url(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fx.normalized_url(F.col("url")).alias("url"))


@query(r"select page_id, coalesce(nullif(regexp_extract(url, '/en/(\d+)', 1), ''), nullif(regexp_extract(url, '/(\d+)', 1), '')) as id from pages", "pages")
def x13_extract_ids_from_url(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fx.first_match(F.col("url"), [r"/en/(\d+)", r"/(\d+)"]).alias("id"))


@query("""select doc_id, case when n_chars < 1024 then printf('%.2f B', n_chars::double) else printf('%.2f KB', round(n_chars / 1024.0, 2)) end as size, case when n_chars < 60 then '0m' else trim(case when n_chars >= 86400 then (n_chars // 86400) || 'd ' else '' end || case when n_chars // 3600 % 24 > 0 then (n_chars // 3600 % 24) || 'h ' else '' end || case when n_chars // 60 % 60 > 0 then (n_chars // 60 % 60) || 'm' else '' end) end as duration,
          printf('%02d:%02d:%02d.%03d', n_chars // 3600000, n_chars // 60000 % 60, n_chars // 1000 % 60, n_chars % 1000) as clock from documents""", "documents")
def x14_format_size_and_duration(documents: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    return documents.select("doc_id", fx.formatted_size(n).alias("size"), fx.formatted_duration(n).alias("duration"), fx.clock(n).alias("clock"))


@query("select event_id, case event_id % 3 when 0 then (event_id % 60) * 60000 + 5000 when 1 then 3600000 + 60000 * (event_id % 60) else -(1000 * (event_id % 60) + 500) end as ms from events", "events")
def x15_parse_time_tokens(events: DataFrame) -> DataFrame:
    k, n = F.col("event_id") % 3, F.col("event_id") % 60
    text = F.when(k == 0, F.format_string("%d:05", n)).when(k == 1, F.format_string("1:%02d:00", n)).otherwise(F.format_string("-00h00m%02ds0500ms", n))
    return events.select("event_id", fx.clock_ms(text).alias("ms"))


@query("""select event_id, case event_id % 5 when 0 then timestamp '2024-02-01 12:00:00' - to_hours(cast(event_id % 9 as int)) when 1 then timestamp '2024-02-01 12:00:00' - to_days(cast(event_id % 9 as int)) when 2 then timestamp '2024-01-31 00:00:00' when 3 then timestamp '1970-01-01' + to_seconds(1700000000 + event_id) end as ts from events""", "events")
def x16_parse_relative_or_absolute_date(events: DataFrame) -> DataFrame:
    k, n = F.col("event_id") % 5, (F.col("event_id") % 9).cast("string")
    text = F.when(k == 0, F.concat(n, F.lit(" h"))).when(k == 1, F.concat(n, F.lit("d"))).when(k == 2, "Yesterday").when(k == 3, (1700000000 + F.col("event_id")).cast("string")).otherwise("some day")
    return events.select("event_id", fx.parsed_time(text, F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")).alias("ts"))


@query("select event_id, greatest(timestamp '2024-01-01 00:00:00', ts - interval 1500 milliseconds) as ts from events", "events")
def x17_shift_timestamps(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.greatest(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts") - F.expr("interval 1.5 seconds")).alias("ts"))


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), ' {2,}#', ' #', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as text from pages", "pages")
def x18_clean_text_lines(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fx.plain_lines(F.col("html")).alias("text"))


@query(r"""with l as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), f as (select *, lag(line) over (partition by doc_id order by pos) as before from l where line <> '')
           select d.doc_id, coalesce(string_agg(f.line, chr(10) order by f.pos) filter (where f.before is null or f.before <> f.line), '') as text from documents d left join f using (doc_id) group by 1""", "documents")
def x19_normalize_whitespace_lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fx.squeezed_lines(F.col("text")).alias("text"))


@query("select page_id, regexp_extract(html, '<title>.*?</title>', 0, 's') as title from pages", "pages")
def x20_substring_between_markers(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fx.between(F.col("html"), "<title>", "</title>").alias("title"))


@query("with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), f as (select doc_id, arg_min(line, pos) as line from l where line <> '' and lower(line) <> 'anble anes.' group by 1) select d.doc_id, coalesce(left(f.line, 160), 'Post ' || d.doc_id) as title from documents d left join f using (doc_id)", "documents")
def x21_derive_title(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fx.derived_title(F.col("text"), ["anble anes."], F.concat(F.lit("Post "), "doc_id")).alias("title"))


@query("select doc_id, left(sha256(source || chr(10) || text), 24) as fingerprint, md5(text) as digest from documents", "documents")
def x22_fingerprints(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", fx.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), F.md5("text").alias("digest"))


@query("select doc_id, case doc_id % 4 when 0 then lang when 1 then lang when 2 then 'de' end as code from documents", "documents")
def x23_classify_language_alias(documents: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.upper("lang")).when(k == 1, F.concat(F.lit("Track "), "lang", F.lit(" 5.1"))).when(k == 2, "audiogerman5").otherwise("??")
    return documents.select("doc_id", fx.language_of_alias(text).alias("code"))


@query("select p_partkey, replace(p_name, ' ', '; ') || '; ' || p_brand as files from part", "part")
def x24_split_file_list(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.array_join(fx.file_list(F.concat("p_name", F.lit(";; "), "p_brand", F.lit(", "))), "; ").alias("files"))


@query("select p_partkey, p_name as name, round(p_retailprice * 1000000 / (1024.0 * 1024 * 1024), 2) as gb from part", "part")
def x25_strip_index_and_size_suffix(part: DataFrame) -> DataFrame:
    name = F.concat("p_size", F.lit(". "), "p_name", F.lit(" 1.23GB"))
    return part.select("p_partkey", fx.without_index_and_size(name).alias("name"), F.round(F.col("p_retailprice") * 1000000 / F.lit(1024.0**3), 2).alias("gb"))


@query("select p_partkey, p_name || ' x' as name from part", "part")
def x26_strip_parentheses_and_emoji(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", fx.without_parentheses(F.concat(F.lit("(a) "), "p_name", F.lit(" \U0001F600x(b)"))).alias("name"))


@query(r"select page_id, regexp_extract(split_part(url, '/', -1), '\.([^.]+)$', 1) as ext, regexp_replace(split_part(url, '/', -1), '\.[^.]+$', '') as stem, left(url, length(url) - length(split_part(url, '/', -1)) - 1) as parent, split_part(url, '/', 1) as first from pages", "pages")
def x27_path_parts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", fx.path_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("select doc_id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then 'he said (the ' || lang || ')' else 'a b' end as line from documents", "documents")
def x28_descriptive_phrase_rule(documents: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 3
    line = F.when(k == 0, "♪ [door slams] ♪").when(k == 1, F.concat(F.lit("he said (the "), "lang", F.lit(")"))).otherwise("a (Loud Music) b")
    return documents.select("doc_id", fx.without_descriptive_fragments(line, ["door slams"], ["music"], ["loud", "the"]).alias("line"))


@query("select l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice, 2) as product, length(l_returnflag || l_linestatus) as letters, greatest(l_returnflag, l_linestatus) as largest, round((l_quantity * 2 + l_linenumber * 3) / 5.0, 2) as weighted from lineitem", "lineitem")
def x29_row_math(lineitem: DataFrame) -> DataFrame:
    product = F.get(F.zip_with(F.array("l_quantity"), F.array("l_extendedprice"), lambda a, b: a * b), 0)
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(product, 2).alias("product"), F.length(F.concat("l_returnflag", "l_linestatus")).alias("letters"),
        F.greatest("l_returnflag", "l_linestatus").alias("largest"), F.round((F.col("l_quantity") * 2 + F.col("l_linenumber") * 3) / 5.0, 2).alias("weighted"),
    )


@query("""with r as (select user_id, event_id, cast(floor(sum(cast(value as decimal(18,2))) over (partition by user_id order by event_id rows unbounded preceding)) as bigint) as reading from events), c as (select *, reading - lag(reading) over (partition by user_id order by event_id) as used from r)
          select user_id, event_id, used, cast(round((used * 0.50 + used * 0.25 + 12.00) * 1.20 + 7.50, 2) as double) as bill from c where used is not null""", "events")
def x30_tariff_bill(events: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("event_id")
    read = events.select("user_id", "event_id", F.floor(F.sum(F.col("value").cast("decimal(18,2)")).over(w.rowsBetween(W.unboundedPreceding, 0))).alias("reading"))
    used = read.withColumn("used", F.col("reading") - F.lag("reading").over(w)).where("used is not null")
    dec = lambda x: F.lit(x).cast("decimal(6,2)")
    bill = (F.col("used").cast("decimal(18,0)") * dec("0.50") + F.col("used").cast("decimal(18,0)") * dec("0.25") + dec("12.00")) * dec("1.20") + dec("7.50")
    return used.select("user_id", "event_id", "used", F.round(bill, 2).cast("double").alias("bill"))


@query("""with recursive g as (select o_orderkey, 0 as t, floor(o_totalprice) + 100.0 as amount from orders union all select o_orderkey, t + 1, amount * 1.01 + 100.0 * pow(1.05, t) from g where t < 6)
          select o_orderkey, t, round(amount, 1) as amount from g""", "orders")
def x31_compound_growth_schedule(orders: DataFrame) -> DataFrame:
    plans = orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"), (F.floor("o_totalprice") + 100.0).alias("a0"))
    grown = F.when(F.col("t") == 0, F.col("a0")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest("t", F.lit(1))), F.col("a0"), lambda a, i: a * 1.01 + F.lit(100.0) * F.pow(F.lit(1.05), i - 1)))
    return plans.select("o_orderkey", "t", F.round(grown, 1).alias("amount"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, coalesce(json_extract_string(props, '$.author.name'), 'Unknown') as author from events", "events")
def x32_nested_defaults(events: DataFrame) -> DataFrame:
    p = F.from_json("props", "k string, author struct<name: string>")
    return events.select("event_id", F.coalesce(p["k"], F.lit("")).alias("k"), F.coalesce(p["author"]["name"], F.lit("Unknown")).alias("author"))


@query("with p as (select p_partkey, [split_part(p_name, ' ', 1), p_brand] as l, [p_brand, p_type] as r from part) select distinct p_partkey, unnest(l || r) as path from p", "part")
def x33_explode_pair_locations(part: DataFrame) -> DataFrame:
    left, right = F.array(F.substring_index("p_name", " ", 1), "p_brand"), F.array("p_brand", "p_type")
    return part.select("p_partkey", F.explode(F.array_distinct(F.concat(left, right))).alias("path"))


_PROFILE = r"""with d as (select doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-zäöüßéèêàçñóíáú]{2,}')) as words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters from documents),
             w as (select doc_id, lang, unnest(words) as word from d), p as (select word, lang, count(*) as n from w where doc_id % 2 = 0 group by 1, 2 having count(*) >= 5),
             s as (select w.doc_id, p.lang, count(*) as n from w join p on p.word = w.word group by 1, 2), t as (select *, sum(n) over (partition by doc_id) as total, row_number() over (partition by doc_id order by n desc, lang) as r, lead(n) over (partition by doc_id order by n desc, lang) as second from s)"""


@query(_PROFILE + """ select d.doc_id, case when d.letters < 80 then 'unknown' when t.lang is null or t.n / t.total < 0.55 or (t.n - coalesce(t.second, 0)) / t.total < 0.15 then 'inconclusive' when t.lang = 'en' and t.n / t.total >= 0.75 and (t.n - coalesce(t.second, 0)) / t.total >= 0.2 then 'target' else 'other' end as decision
                      from d left join t on t.doc_id = d.doc_id and t.r = 1""", "documents")
def x34_language_decision(documents: DataFrame) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßéèêàçñóíáú]{2,}"), 0))
    d = documents.select("doc_id", "lang", words.alias("words"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"))
    w = d.select("doc_id", "lang", F.explode("words").alias("word"))
    profile = w.where("doc_id % 2 = 0").groupBy("word", "lang").agg(F.count("*").alias("n")).where("n >= 5").select("word", F.col("lang").alias("code"))
    scores = w.join(profile, "word").groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    over = W.partitionBy("doc_id").orderBy(F.desc("n"), "code")
    top = scores.select("doc_id", "code", "n", F.sum("n").over(W.partitionBy("doc_id")).alias("total"), F.row_number().over(over).alias("r"), F.coalesce(F.lead("n").over(over), F.lit(0)).alias("second")).where("r = 1")
    share, margin = F.col("n") / F.col("total"), (F.col("n") - F.col("second")) / F.col("total")
    decision = F.when(F.col("letters") < 80, "unknown").when(F.col("code").isNull() | (share < 0.55) | (margin < 0.15), "inconclusive").when((F.col("code") == "en") & (share >= 0.75) & (margin >= 0.2), "target").otherwise("other")
    return d.join(top, "doc_id", "left").select("doc_id", decision.alias("decision"))


@query("select p_brand, p_name as stem, count(*) as n from part group by 1, 2", "part")
def x35_tag_family_key(part: DataFrame) -> DataFrame:
    raw = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "_pt.cleaned").otherwise("_en_xx"))
    return part.groupBy("p_brand", fx.tag_family(raw).alias("stem")).agg(F.count("*").alias("n"))


@query("select cast(event_id // 50 as bigint) as text_id, cast(row_number() over (partition by event_id // 50 order by event_id) - 1 as int) as pos, cast(event_id as int) as index, case when event_type <> 'error' then 1000 * (event_id % 50) end as start_ms, event_type <> 'error' as valid from events", "events")
def p1_explode_cues(events: DataFrame) -> DataFrame:
    second = F.lpad((F.col("event_id") % 50).cast("string"), 2, "0")
    cue = F.concat_ws("\n", F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "bad time").otherwise(F.concat(F.lit("00:00:"), second, F.lit(",000 --> 00:00:"), second, F.lit(",500"))), F.lit("Hello"))
    texts = events.groupBy(F.floor(F.col("event_id") / 50).alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("text"))
    cues = tx.explode_cues(texts, "text")
    return cues.select("text_id", "pos", F.coalesce("index", F.get("lines", 0).cast("int")).alias("index"), "start_ms", "valid")


@query("""with c as (select source, doc_id, case doc_id % 3 when 0 then '[door slams]' when 1 then 'hi (loud music)' else 'plain' end as before from documents), a as (select *, case doc_id % 3 when 0 then '' when 1 then 'hi' else 'plain' end as after from c)
          select source, doc_id, before, after, case when after = '' then 'removed' when after <> before then 'modified' else 'kept' end as status, case when after <> '' then row_number() over (partition by source, after = '' order by doc_id) end as number from a""", "documents")
def p2_clean_cues_with_change_log(documents: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 3
    cues = documents.select("source", "doc_id", F.when(k == 0, "[door slams]").when(k == 1, "hi (loud music)").otherwise("plain").alias("before"))
    cues = cues.withColumn("after", fx.without_descriptive_fragments(F.col("before"), ["door slams"], ["music"], ["loud"]))
    status = F.when(F.col("after") == "", "removed").when(F.col("after") != F.col("before"), "modified").otherwise("kept")
    number = F.row_number().over(W.partitionBy("source", F.col("after") == "").orderBy("doc_id")).cast("long")
    return cues.withColumns({"status": status, "number": F.when(F.col("after") != "", number)})


@query("select p_partkey, p_size % 3 > 0 as accepted, case when p_size % 3 > 0 then p_name end as name, case when p_size % 3 > 0 then 1950 + p_size end as year, case when p_size % 3 = 1 then 'a+b' when p_size % 3 = 2 then '' end as icons from part", "part")
def p3_explode_collection_lines(part: DataFrame) -> DataFrame:
    k = F.col("p_size") % 3
    line = F.concat("p_name", F.when(k > 0, F.concat(F.lit(" ("), 1950 + F.col("p_size"), F.lit(")"))).otherwise(" (n/a)"), F.when(k == 1, " [a][b]").otherwise(""))
    out = tx.collection_lines(part.select("p_partkey", line.alias("line")), "line")
    return out.select("p_partkey", "accepted", "name", "year", F.array_join("icons", "+").alias("icons"))


@query("with r as (select 'f' || (p_partkey // 40) as file, count(*) as n from part group by 1) select file, 'call' as kind, n - 1 as n from r where n > 1 union all select file, 'def', n from r union all select file, 'import', n + 2 from r", "part")
def p4_extract_source_symbols(part: DataFrame) -> DataFrame:
    from tessera.plans.joins import _sources

    return tx.source_symbols(_sources(part)).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("select cast(p_partkey // 50 as bigint) as text_id, row_number() over (partition by p_partkey // 50 order by p_partkey) as pos, 'article' as type, 'key' || p_partkey as citekey from part", "part")
def p5_explode_bib_entries(part: DataFrame) -> DataFrame:
    entry = F.concat(F.lit("@Article{key"), "p_partkey", F.lit(", title = {"), "p_name", F.lit("}}\n"))
    texts = part.groupBy(F.floor(F.col("p_partkey") / 50).alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "").alias("text"))
    return tx.bib_entries(texts, "text").select("text_id", F.col("pos").cast("long").alias("pos"), "type", "citekey")
