"""Queries of sequence and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import sequences as op
from tessera.operators.blocks import lag_products
from tessera.plans.registry import query

_U = "with u as (select vec_id, label, [x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])) for x in embedding] as v from embeddings)"


@query(_U + " select vec_id, round(v[1], 4) + 0.0 as first, round(v[64], 4) + 0.0 as last, round(list_inner_product(v, v), 6) as square from u", "embeddings")
def v1_l2_normalize(embeddings: DataFrame) -> DataFrame:
    v = embeddings.select("vec_id", fx.l2_normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", (F.round(F.get("v", 0), 4) + F.lit(0.0)).alias("first"), (F.round(F.get("v", 63), 4) + F.lit(0.0)).alias("last"), F.round(fx.dot(F.col("v"), F.col("v")), 6).alias("square"))


@query("""with h as (select vec_id, embedding[1:24]::double[] as a, embedding[33:56]::double[] as b from embeddings), n as (select vec_id, [x / sqrt(list_inner_product(a, a)) / sqrt(2.0) for x in a] || [x / sqrt(list_inner_product(b, b)) / sqrt(2.0) for x in b] as c from h)
          select vec_id, round(c[1], 4) + 0.0 as first, round(c[25], 4) + 0.0 as middle, len(c) as dims from n""", "embeddings")
def v2_combine_modalities(embeddings: DataFrame) -> DataFrame:
    c = embeddings.select("vec_id", op.combined([F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)]).alias("c"))
    return c.select("vec_id", (F.round(F.get("c", 0), 4) + F.lit(0.0)).alias("first"), (F.round(F.get("c", 24), 4) + F.lit(0.0)).alias("middle"), F.size("c").cast("long").alias("dims"))


@query(_U + ", s as (select a.vec_id as q, b.vec_id as p, round(list_inner_product(a.v, b.v), 6) as s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), t as (select * from s qualify row_number() over (partition by q order by s desc, p) <= 20) select p - q as \"offset\", count(*) as votes from t where p - q >= 10 and s >= 0.2 group by 1", "embeddings")
def v3_candidate_offset_votes(embeddings: DataFrame) -> DataFrame:
    u = embeddings.select("vec_id", fx.l2_normalized(F.col("embedding")).alias("v"))
    return op.offset_votes(u.where("vec_id % 20 = 0"), u, "vec_id", "v", 20, 0.2, 10)


#: Offsets that are searched at most, those of most votes first.
MOST_OFFSETS = 512


def _series(embeddings: DataFrame) -> DataFrame:
    """Similarities of each vector and those the voted offsets further on."""
    u = embeddings.select("vec_id", fx.l2_normalized(F.col("embedding")).alias("v"))
    votes = op.offset_votes(u.where("vec_id % 20 = 0"), u, "vec_id", "v", 20, 0.2, 10)
    offsets = [r.offset for r in votes.orderBy(F.desc("votes"), "offset").limit(MOST_OFFSETS).collect()]
    return lag_products(u, "vec_id", "v", offsets).withColumnsRenamed({"lag": "offset", "product": "similarity"})


_SEGMENTS = _U.replace("with u as", "with recursive u as") + f""", n as (select a.vec_id as q, b.vec_id as p, round(list_inner_product(a.v, b.v), 6) as s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
    t as (select * from n qualify row_number() over (partition by q order by s desc, p) <= 20),
    o as (select p - q as "offset", count(*) as votes from t where p - q >= 10 and s >= 0.2 group by 1 order by votes desc, "offset" limit {MOST_OFFSETS}),
    se as (select o."offset", a.vec_id as pos, list_inner_product(a.v, b.v) as s from o join u a on true join u b on b.vec_id = a.vec_id + o."offset"),
    m as (select *, count(*) over w as k, avg(s) over w as mean from se window w as (partition by "offset" order by pos rows between current row and 2 following)),
    f as (select *, case when pos - lag(pos) over (partition by "offset" order by pos) > 3 then 1 else 0 end as fresh from m where k = 3 and mean >= 0.15),
    i as (select *, sum(fresh) over (partition by "offset" order by pos) as island from f),
    r as (select "offset", min(pos) as first, max(pos) + 2 as last from i group by "offset", island),
    e as (select r."offset", r.first, r.last, min(se.pos) as lo, max(se.pos) as hi from r join se on se."offset" = r."offset" and se.pos between r.first and r.last where se.s >= 0.1 group by all),
    found as (select e."offset", e.lo as first, e.hi as last, round(avg(se.s) * 100, 2) as confidence from e join se on se."offset" = e."offset" and se.pos between e.lo and e.hi group by all)"""


@query(_SEGMENTS + ' select * from found', "embeddings")
def v4_repeated_segments(embeddings: DataFrame) -> DataFrame:
    return op.repeated_segments(_series(embeddings), "pos", "similarity", 3, 0.15, 2, 0.1)


def _meet(shift: str) -> str:
    """SQL: a record x and a kept one overlap by four fifths of the shorter."""
    at = lambda r, end: f"{r}.{end}" + (f' + {r}."offset"' if shift else "")
    return f"least({at('x', 'last')}, {at('k', 'last')}) - greatest({at('x', 'first')}, {at('k', 'first')}) >= 0.8 * greatest(1e-9, least(x.last - x.first, k.last - k.first))"


@query(_SEGMENTS + f""", x as (select *, first // 100 as file, row_number() over (partition by first // 100 order by last - first desc, confidence desc, "offset", first) as n from found),
    g as (select distinct file, cast(0 as bigint) as n, cast([] as struct("offset" bigint, first bigint, last bigint, confidence double)[]) as kept from x
      union all select g.file, x.n, case when len(list_filter(g.kept, lambda k: (abs(x.first - k.first) <= 1.5 and abs(x.first + x."offset" - k.first - k."offset") <= 1.5) or ({_meet('')} and {_meet('offset')}))) = 0
        then list_append(g.kept, struct_pack("offset" := x."offset", first := x.first, last := x.last, confidence := x.confidence)) else g.kept end from g join x on x.file = g.file and x.n = g.n + 1),
    l as (select file, arg_max(kept, n) as kept from g group by 1)
    select r."offset", r.first, r.last, r.confidence, file from (select file, unnest(kept) as r from l)""", "embeddings")
def v5_dedupe_overlapping_records(embeddings: DataFrame) -> DataFrame:
    found = op.repeated_segments(_series(embeddings), "pos", "similarity", 3, 0.15, 2, 0.1)
    return op.without_overlaps(found.withColumn("file", F.floor(F.col("first") / 100)), "file")


@query("""with a as (select label, vec_id, [cast(x >= 0 as int) for x in embedding[1:64]] as h from embeddings), d as (select a.label, list_sum([abs(a.h[i] - b.h[i]) for i in range(1, 65)]) as d from a join a b on b.vec_id = a.vec_id + 1)
          select label, round(avg(cast(d < 30 as int)), 4) as ratio, round(avg(cast(d < 30 as int)), 4) >= 0.4 as similar from d group by 1""", "embeddings")
def v6_hash_sequence_similarity(embeddings: DataFrame) -> DataFrame:
    a = embeddings.select("label", F.col("vec_id").alias("pos"), op.sign_bits(F.col("embedding")).alias("hash"))
    b = embeddings.select((F.col("vec_id") - 1).alias("pos"), op.sign_bits(F.col("embedding")).alias("hash")).join(a.select("label", "pos"), "pos")
    return op.hash_similarity(a, b, ["label", "pos"], 30, 0.4)


@query("""with h as (select cast(epoch(date_trunc('hour', ts)) / 3600 as bigint) as hour, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click') as b from events group by 1), c as (select hour, a - avg(a) over () as x, b - avg(b) over () as y from h),
          n as (select hour, x / max(abs(x)) over () as x, y / max(abs(y)) over () as y from c), s as (select l.lag, sum(p.x * q.y) as c from n p, (select unnest(range(-6, 7)) as lag) l join n q on q.hour = p.hour + l.lag group by 1) select cast(lag as int) as lag, round(c, 4) as correlation from s order by round(abs(c), 6) desc, lag limit 1""", "events")
def v7_best_lag_correlation(events: DataFrame) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.date_trunc("HOUR", "ts").cast("timestamp")) / 3600)
    counted = events.groupBy(hour.alias("hour")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return op.best_lag(counted, "a", "b", "hour", 6)


@query("select strlen(text) as size, md5(text) as digest, count(*) as n, min(doc_id) as first, string_agg(doc_id, ',' order by doc_id) as ids from documents group by 1, 2 having count(*) > 1", "documents")
def v8_content_equality(documents: DataFrame) -> DataFrame:
    return op.equal_content(documents, "doc_id", "text")


@query("select strlen(text) as size, md5(text) as digest, row_number() over (partition by strlen(text), md5(text) order by doc_id) as place, doc_id from documents qualify count(*) over (partition by strlen(text), md5(text)) > 1", "documents")
def v8_equal_members(documents: DataFrame) -> DataFrame:
    return op.equal_members(documents, "doc_id", "text")
