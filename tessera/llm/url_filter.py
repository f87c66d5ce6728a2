"""Allow and block rules for urls, spread over redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, free_names, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only tell where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: The production rules: (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """Between ``://`` and the first of / ? #, A-Z lower-cased; empty of a null url or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ? or #; empty where there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The url's normal form: https, no fragment, no tracking parameters, no slash at the end."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})=")), "&")
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.when(_rest(url).isNotNull(), F.concat(F.lit("https://"), url_host(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """The path, which begins with a slash, after its . and .. segments are followed."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    up = lambda done: F.regexp_replace(done, "/[^/]*$", "")
    walked = F.aggregate(parts, F.lit(""), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x)))
    return F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.lit("/"))).otherwise(walked)


def _absolute(link: Column, base: Column) -> Column:
    """What a link on the page ``base`` names, as a browser takes it; null of an empty one, a place in the page, and other
    schemes such as mailto."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, "^[^:]*:", 0)
    site = F.concat(scheme, F.lit("//"), url_host(base))
    path, rest = F.regexp_extract(link, "^[^?#]*", 0), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(F.concat(url_path(base), F.when(url_path(base) == "", "/").otherwise("")), "^.*/", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|$)") | _rest(base).isNull(), None)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, _without_dots(path), rest))
        .when(link.startswith("?"), F.concat(site, url_path(base), link))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each url with its normal form, and with what its page's first canonical link and first refresh name, their
    attributes in any order. Links are relative to the page's first ``<base href>``, if it has one."""
    url, html = F.col(url_col), F.col(html_col)
    own = pages.select(url.alias("a"), canonical_url(url).alias("b"))
    value = lambda tag, name: F.regexp_extract(F.regexp_extract(html, tag, 0), rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)
    naming = pages.where(html.rlike("(?i)canonical|http-equiv")).select(
        url.alias("a"), value(r"(?is)<base\b[^>]*\bhref\s*=[^>]*>", "href").alias("base"),
        value(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", "href").alias("canonical"),
        value(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", "url").alias("refresh"),
    ).where("canonical <> '' or refresh <> ''")
    based = naming.select("a", F.coalesce(F.when(F.col("base") != "", _absolute(F.col("base"), F.col("a"))), "a").alias("base"), F.explode(F.array("canonical", "refresh")).alias("link"))
    based = written(based.where("link <> ''"), "page-links")  # else the base would stand in full at each place of the next expression
    named = based.select("a", _absolute(F.col("link"), F.col("base")).alias("b"))
    return own.union(named).where("b is not null and a <> b").distinct()


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url) with host, path and the longest fitting rule: (action, rule), null where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally long rules
    an allowing one wins, then the smaller text. An equi join on the host's suffixes: no rule list is too long.
    """
    urls = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), (F.col("action") == "allow").alias("allows"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("action"),
    )
    fits = (
        urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("url").agg(F.max(rule).alias("best"))
    )
    return urls.join(fits, "url", "left").select("url", "host", "path", "best.action", "best.rule")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict ('allow' or 'block').

    A url with a rule of its own gets that rule's action. Another one is blocked when an alias of it (any
    url of its component) is blocked by a rule and none is allowed by one; else allowed. Null url: empty
    host and path, allowed. Repeated rows stay; columns named like the added ones are replaced.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, rule_host string, rule_path string")
    edges = written(link_edges(pages, url_col, html_col), "links")
    groups = components(edges)
    urls = pages.select(F.col(url_col).alias("url")).union(edges.select("b")).where("url is not null").distinct()
    judged = written(apply_rules(urls, rules).join(groups.withColumnRenamed("node", "url"), "url", "left"), "judged-urls")
    spread = (
        judged.where("root is not null and action is not null")
        .groupBy("root").agg(F.bool_or(F.col("action") == "allow").alias("allows"))
    )
    spread = written(spread, "judged-components")
    kept = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c not in (url_col, html_col)])
    (mine,) = free_names([*kept.columns, "host", "path", "rule", "verdict"], "url")
    verdicts = judged.join(spread, "root", "left").select(
        F.col("url").alias(mine), "rule",
        F.coalesce("action", F.when(F.col("allows"), "allow").when(~F.col("allows"), "block"), F.lit("allow")).alias("verdict"),
    )
    out = kept.join(verdicts, F.col(url_col) == F.col(mine), "left").drop(mine)
    return out.withColumns({
        "host": url_host(F.col(url_col)), "path": url_path(F.col(url_col)), "verdict": F.coalesce("verdict", F.lit("allow")),
    })
