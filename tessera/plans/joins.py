"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import joins as op
from tessera.plans.registry import query


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')", "lineitem orders")
def j1_semi_join_changed_files(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    changed = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return op.changed_only(lineitem, changed, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, row_number() over (order by o_orderkey desc) as number from orders where o_orderkey % 5 = 0", "orders")
def j2_divergent_rows(orders: DataFrame) -> DataFrame:
    return op.divergent(orders, orders.where("o_orderkey % 5 <> 0"), "o_orderkey", "o_orderkey").select("o_orderkey", "number")


@query("""with a as (select distinct lower(replace(c_name, 'Customer#', '')) as name, c_nationkey as nation from customer), b as (select distinct lower(replace(s_name, 'Supplier#', '')) as name, s_nationkey as nation from supplier)
          select 'first' as side, a.name || ' - ' || a.nation as entry from a where not exists (select 1 from b where b.name = a.name and b.nation = a.nation)
          union all select 'second', b.name || ' - ' || b.nation from b where not exists (select 1 from a where b.name = a.name and b.nation = a.nation)""", "customer supplier")
def j3_two_way_anti_on_normalized_pair(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    a = customer.select(F.replace("c_name", F.lit("Customer#"), F.lit(" ")).alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    b = supplier.select(F.replace("s_name", F.lit("Supplier#"), F.lit("")).alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return op.two_way_anti(a, b, ["name", "nation"]).select("side", F.concat_ws(" - ", "name", "nation").alias("entry"))


@query("""with a as (select distinct c_custkey as k from customer), b as (select distinct user_id as k from events)
          select coalesce(a.k, b.k) as person, case when a.k is null then 'right' when b.k is null then 'left' else 'common' end as place from a full join b on a.k = b.k""", "customer events")
def j4_three_way_set_compare(customer: DataFrame, events: DataFrame) -> DataFrame:
    return op.three_way_compare(customer.select(F.col("c_custkey").alias("person")), events.select(F.col("user_id").alias("person")), "person")


@query("select c_custkey, c_nationkey from customer where c_custkey not in (select user_id from events)", "customer events")
def j5_one_way_diff(customer: DataFrame, events: DataFrame) -> DataFrame:
    return op.one_way_diff(customer, events.withColumnRenamed("user_id", "c_custkey"), "c_custkey").select("c_custkey", "c_nationkey")


@query("select distinct p.page_id, d.d as name from (select page_id, ' ' || regexp_replace(lower(html), '[^a-z]+', ' ', 'g') || ' ' as t from pages) p, (select distinct 'the ' || lower(left(lang, 2)) as d from documents union select 'of the' union select 'the that' union select 'in the') d where contains(p.t, ' ' || d.d || ' ')", "pages documents")
def j6_containment_join(pages: DataFrame, documents: DataFrame) -> DataFrame:
    texts = pages.select("page_id", F.regexp_replace(F.lower("html"), "[^a-z]+", " ").alias("text"))
    langs = documents.select(F.concat(F.lit("the "), F.left("lang", F.lit(2))).alias("name")).distinct()
    names = langs.union(langs.limit(1).select(F.explode(F.array(F.lit("of the"), F.lit("the that"), F.lit("in the")))))
    return op.word_containment(texts, names, "page_id", "text", "name")


@query(None, "part")
def j7_fuzzy_title_join(part: DataFrame) -> DataFrame:
    return op.fuzzy_pairs(part, "p_size", "p_brand", "p_name", 0.9)


@query(None, "part")
def j8_greedy_group_assembly(part: DataFrame) -> DataFrame:
    return op.assemble_groups(op.fuzzy_pairs(part, "p_size", "p_brand", "p_name", 0.9), "p_size")


@query("""with t as (select p.p_partkey, case when exists (select 1 from part q where q.p_type = 'PROMO' and q.p_name || '/' || q.p_size = p.p_name || '/' || p.p_size) then 1
            when exists (select 1 from part q where q.p_type = 'PROMO' and upper(q.p_name) = upper(p.p_name) and q.p_size % 10 = p.p_size % 10) then 2
            when exists (select 1 from part q where q.p_type = 'PROMO' and split_part(q.p_name, ' ', 1) = split_part(p.p_name, ' ', 1) and q.p_brand = p.p_brand) then 3 end as tier from part p),
          m as (select t.p_partkey, t.tier, count(q.p_partkey) as n, min(q.p_partkey) as hit from t join part p on p.p_partkey = t.p_partkey left join part q on q.p_type = 'PROMO' and
            ((t.tier = 1 and q.p_name || '/' || q.p_size = p.p_name || '/' || p.p_size) or (t.tier = 2 and upper(q.p_name) = upper(p.p_name) and q.p_size % 10 = p.p_size % 10)
             or (t.tier = 3 and split_part(q.p_name, ' ', 1) = split_part(p.p_name, ' ', 1) and q.p_brand = p.p_brand)) group by all)
          select p_partkey, case when n = 1 then hit end as hit, cast(tier as bigint) as tier, case when tier is null then 'missing' when n > 1 then 'ambiguous' else 'matched' end as status from m""", "part")
def j9_tiered_match_join(part: DataFrame) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    exact, folded, stem = F.concat_ws("/", name, size), F.concat_ws("/", F.upper(name), size % 10), F.concat_ws("/", F.substring_index(name, " ", 1), "p_brand")
    candidates = part.where("p_type = 'PROMO'").withColumn("hit", F.col("p_partkey"))
    return op.tiered_match(part, candidates, "p_partkey", [(exact, exact), (folded, folded), (stem, stem)], "hit")


@query("""with a as (select p_partkey, p_brand || '/' || p_size as dir, split_part(p_name, ' ', 1) as stem from part where p_type = 'ECONOMY'), b as (select p_partkey as side_key, p_brand || '/' || p_size as dir, p_name as side from part where p_type <> 'ECONOMY')
          select p_partkey, side_key from a join b using (dir) where lower(side) = lower(stem) or (starts_with(lower(side), lower(stem)) and substr(side, length(stem) + 1, 1) in ('.', ' ', '-', '_'))""", "part")
def j10_prefix_join(part: DataFrame) -> DataFrame:
    a = part.where("p_type = 'ECONOMY'").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("dir"), F.substring_index("p_name", " ", 1).alias("stem"))
    b = part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("side_key"), F.concat_ws("/", "p_brand", "p_size").alias("dir"), F.col("p_name").alias("side"))
    return op.prefix_join(a, b, "dir", "stem", "side", strict=True).select("p_partkey", "side_key")


@query("""with m as (select p_brand as dir, split_part(p_name, ' ', 2) as movie, p_size as e from part where p_type = 'ECONOMY'), s as (select p_brand as dir, p_name as subtitle, p_size as e, p_partkey as pos from part where p_type <> 'ECONOMY')
          select m.dir, movie, arg_min(subtitle, pos) as subtitle from m join s on m.dir = s.dir and (m.e = s.e or contains(subtitle, movie)) group by all""", "part")
def j11_name_or_episode_join(part: DataFrame) -> DataFrame:
    m = part.where("p_type = 'ECONOMY'").select(F.col("p_brand").alias("dir"), F.get(F.split("p_name", " "), 1).alias("stem"), F.col("p_size").alias("episode"))
    s = part.where("p_type <> 'ECONOMY'").select(F.col("p_brand").alias("dir"), F.col("p_name").alias("stem"), F.col("p_size").alias("episode"), F.col("p_partkey").alias("pos"))
    return op.name_or_episode(m, s, "dir")


@query("select c.c_custkey, arg_min(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) as o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey group by 1", "customer orders")
def j12_first_exact_lookup(customer: DataFrame, orders: DataFrame) -> DataFrame:
    results = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("rank"))
    return op.first_exact(customer.select("c_custkey"), results, "c_custkey", "o_orderkey", "rank")


@query("""with a as (select conv_id, turn, role from conversations), b as (select conv_id, turn, case when conv_id % 3 = 0 and turn = 1 then 'user' else role end as role from conversations where not (conv_id % 5 = 0 and turn = 0))
          select coalesce(a.conv_id, b.conv_id) as conv_id, bool_and(a.conv_id is not null and b.conv_id is not null and a.role is not distinct from b.role) as complete from a full join b on a.conv_id = b.conv_id and a.turn = b.turn group by 1""", "conversations")
def j13_sequence_alignment_check(conversations: DataFrame) -> DataFrame:
    other = conversations.where("not (conv_id % 5 = 0 and turn = 0)").withColumn("role", F.when(F.expr("conv_id % 3 = 0 and turn = 1"), "user").otherwise(F.col("role")))
    return op.aligned(conversations, other, "conv_id", "turn", "role")


@query("""with l as (select 'a' || o_orderkey as src, 'b' || o_orderkey as dst, o_orderkey as k from orders)
          select case when k % 2 = 1 and k % 3 = 0 then 'already_reverted' when k % 2 = 1 then 'missing' when k % 3 = 0 then 'conflict' else 'reverted' end as status, count(*) as n from l group by 1""", "orders")
def j14_log_reconciliation(orders: DataFrame) -> DataFrame:
    log = orders.select(F.concat(F.lit("a"), "o_orderkey").alias("src"), F.concat(F.lit("b"), "o_orderkey").alias("dst"))
    here = orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("a"), "o_orderkey").alias("path")).union(orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("b"), "o_orderkey")))
    return op.reconcile(log, here)


@query("""with c as (select event_id as cut, 'v' || event_id as tag from events where event_type = 'signup')
          select e.event_id, c.tag, row_number() over (partition by c.tag order by e.event_id) as number from events e asof left join c on e.event_id <= c.cut""", "events")
def j15_interval_assignment(events: DataFrame) -> DataFrame:
    cuts = events.where("event_type = 'signup'").select(F.col("event_id").alias("cut"), F.concat(F.lit("v"), "event_id").alias("tag"))
    return op.assign_intervals(events.select("event_id"), cuts, "event_id", "cut", "tag").select("event_id", "tag", "number")


def _sources(part: DataFrame) -> DataFrame:
    """One source file per forty parts: a function per part, named by its size and name, that calls the next part's."""
    from pyspark.sql import Window as W

    file = F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 40))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_size")
    nxt = F.lead(name).over(W.partitionBy(file).orderBy("p_partkey"))
    body = F.concat(F.lit("def "), name, F.lit("():\n    import os\n    return "), F.coalesce(nxt, F.lit("None")), F.when(nxt.isNotNull(), "()").otherwise(""))
    rows = part.select(file.alias("path"), "p_partkey", body.alias("code"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))), lambda x: x["code"]), "\n\n")
    return rows.groupBy("path").agg(F.concat(F.lit("import math\nimport os.path\n\n"), code).alias("source"))


_CODE = "with p as (select 'f' || (p_partkey // 40) as file, replace(p_name, ' ', '_') || p_size as name, p_partkey from part), r as (select *, lead(name) over (partition by file order by p_partkey) as callee from p)"


@query(_CODE + " select file, name from r where name not in (select callee from r where callee is not null)", "part")
def j16_unused_definitions(part: DataFrame) -> DataFrame:
    from tessera.functions.tables import source_symbols

    return op.unused_definitions(source_symbols(_sources(part)))


@query(_CODE + ", d as (select file, name, min(p_partkey) as at from r group by 1, 2) select distinct r.file, r.name as caller, r.callee from r join d a on a.file = r.file and a.name = r.name join d b on b.file = r.file and b.name = r.callee where b.at >= a.at", "part")
def j17_call_before_definition(part: DataFrame) -> DataFrame:
    from tessera.functions.tables import source_symbols

    return op.called_before_definition(source_symbols(_sources(part)))


@query("""with w as (select distinct o_custkey, unnest(['F', 'O', 'P']) as language from orders), x as (select distinct o_custkey, o_orderstatus as language from orders where o_orderkey % 2 = 0), e as (select distinct o_custkey, o_orderstatus as language from orders where o_orderkey % 2 = 1)
          select w.o_custkey, w.language, case when x.language is not null then 'external' when e.language is not null then 'embedded' end as source from w left join x using (o_custkey, language) left join e using (o_custkey, language)""", "orders")
def j18_required_track_presence(orders: DataFrame) -> DataFrame:
    tracks = orders.select("o_custkey", F.col("o_orderstatus").alias("language"), "o_orderkey")
    return op.required_tracks(orders, tracks.where("o_orderkey % 2 = 1"), tracks.where("o_orderkey % 2 = 0"), "o_custkey", ["F", "O", "P"])


@query("select a.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) + 0.0 as compared from embeddings a join embeddings b on b.vec_id = a.vec_id + 100", "embeddings")
def j19_position_aligned_pair_join(embeddings: DataFrame) -> DataFrame:
    later = embeddings.where("vec_id >= 100").withColumn("vec_id", F.col("vec_id") - 100)
    return op.position_pairs(embeddings, later, "vec_id", "embedding", lambda a, b: F.round(fx.dot(a, b), 4) + F.lit(0.0))


@query("select cast(l.lag as bigint) as lag, a.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) + 0.0 as similarity from embeddings a, (select unnest([10, 25, 60]) as lag) l join embeddings b on b.vec_id = a.vec_id + l.lag", "embeddings")
def j20_lag_offset_self_join(embeddings: DataFrame) -> DataFrame:
    return op.lag_pairs(embeddings, "vec_id", "embedding", [10, 25, 60]).select(F.col("lag").cast("long").alias("lag"), "vec_id", (F.round(fx.dot(F.col("a"), F.col("b")), 4) + F.lit(0.0)).alias("similarity"))
