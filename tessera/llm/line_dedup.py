"""Cross-site boilerplate lines: how many sites carry a line, and the texts without such lines.

DataFrame operations only. Sketches of the sites merge by aggregation, one per line hash; only lines
whose estimate lies near the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free_names, hash128, written

#: A line on this many sites is boilerplate.
MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly; at 2^12 registers the sketch's
#: standard error is 1.6 %, so that 20 % is over twelve standard errors.
NEAR = 0.2
LG_REGISTERS = 12
#: Trimmed from a line before it is compared.
BLANK = " \t\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    lines = docs.select(
        F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_text"), F.col(site_col).alias("_site"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"),
    )
    lines = lines.withColumn("_line", F.btrim("_line", F.lit(BLANK))).where("_line <> ''")
    h1, h2 = hash128(F.col("_line"))
    return lines.select("_doc", "_text", "_site", "_pos", h1.alias("_h1"), h2.alias("_h2"))


def boilerplate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """Lines found on ``min_sites`` distinct sites or more: (_h1, _h2, first), ``first`` being (_doc, _pos).

    A null site counts as no site; blank lines never count.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    sketched = written(
        lines.groupBy("_h1", "_h2")
        .agg(F.hll_sketch_agg("_site", LG_REGISTERS).alias("sites"), F.min(F.struct("_doc", "_pos")).alias("first"))
        .select("_h1", "_h2", "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .where(F.col("estimate") >= (1 - NEAR) * min_sites),
        "line-spread",
    )
    sure = sketched.where(F.col("estimate") > (1 + NEAR) * min_sites).drop("estimate")
    near = sketched.where(F.col("estimate") <= (1 + NEAR) * min_sites).drop("estimate")
    exact = (
        lines.join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2").agg(F.count_distinct("_site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return written(sure.unionByName(near.join(exact.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    min_sites: int = MIN_SITES, keep_first: bool = True,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``kept_text``.

    A boilerplate line goes wherever it occurs; with ``keep_first`` its occurrence of smallest id, then
    smallest line number, stays, so that a text which many sites copy is kept once. Null text: zero lines
    and null kept_text; empty text: one line. Repeated rows with equal id and text get equal results; null
    ids are handled as a value of their own. Columns named like the added ones are replaced, others pass.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    found = boilerplate_lines(docs, id_col, text_col, site_col, min_sites)
    hits = lines.drop("_site").join(found, ["_h1", "_h2"])
    if keep_first:
        hits = hits.where(~F.struct("_doc", "_pos").eqNullSafe(F.col("first")))
    docs = docs.drop(*[c for c in ("n_lines", "n_removed", "kept_text") if c not in (id_col, text_col)])
    doc, key, gone = free_names([*docs.columns, "n_lines", "n_removed", "kept_text"], "doc", "key", "gone")
    left = hits.groupBy(F.col("_doc").alias(doc), F.col("_text").alias(key)).agg(F.collect_set("_pos").alias(gone))
    split = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    joined = docs.join(left, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(key)), "left")
    return joined.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long"),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
        ),
    }).drop(doc, key, gone)


def sql(min_sites: int = MIN_SITES) -> str:
    return f"""
    with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line,
                      generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
    t as (select doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) as k from l),
    b as (select k, min((doc_id, pos)) as first from t where k <> ''
          group by k having count(distinct source) >= {min_sites}),
    m as (select t.doc_id, t.pos, t.line, b.k is not null and (t.doc_id, t.pos) <> b.first as gone
          from t left join b on t.k = b.k)
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
           coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept_text
    from m group by doc_id"""
