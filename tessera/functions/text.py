"""Column functions: numbers, names, dates, paths and vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their base letters.
ACCENTS, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
#: Resolution names and their line counts.
RESOLUTIONS = {"2k": "1440p", "4k": "2160p", "8k": "4320p"}
SPECIAL = ["IMAX", "HDR", "AI"]
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Language aliases by the code they mean.
LANGUAGES = {"en": ["en", "eng", "english"], "de": ["de", "ger", "german", "deutsch"], "fr": ["fr", "fre", "french"], "es": ["es", "spa", "spanish"]}
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; as a plain column inside a lambda it would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def l2_normalized(v: Column) -> Column:
    """A unit vector; one of norm up to 1e-12 stays as it is. Vector and norm are computed once."""
    unit = lambda v, n: F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return once(v, lambda v: once(norm(v), lambda n: unit(v, n)))


def brl_money(text: Column) -> Column:
    """``R$ 1.234,56`` as a decimal."""
    return F.replace(F.replace(F.regexp_replace(text, r"[R$\s]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("decimal(18,2)")


def normalized_title(text: Column) -> Column:
    """Lower case, marks off letters, other characters one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTS, PLAIN), r"[^a-z0-9]+", " "))


def without_trailing_index(name: Column) -> Column:
    """A final number of up to three digits goes where the rest has a letter."""
    return F.regexp_replace(name, r"^(.*\p{L}.*)\s+\d{1,3}$", "$1")


def sanitized(name: Column, most: int = 100, reserved: tuple[str, ...] = ("con", "nul", "aux")) -> Column:
    safe = F.left(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit(most))
    return F.when(F.lower(safe).isin(*reserved), F.concat(F.lit("_"), safe)).otherwise(safe)


def clean_song(name: Column) -> Column:
    """``$`` as s, bracketed remarks, remarks after a dash and years removed, spaces squeezed, words capitalised."""
    steps = [(r"\$", "s"), (r"[\(\[][^\)\]]*[\)\]]", " "), (r"(?i)\s-\s(remaster(ed)?|live|radio edit|single version|bonus track).*$", " "), (r"\b(19|20)\d{2}\b", " "), (r"\s+", " ")]
    return F.initcap(F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, name)))


def artist_and_title(text: Column) -> Column:
    """(artist, title) around the first ``" - "``; the whole as title where there is none."""
    at = F.locate(" - ", text)
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("artist"), F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text).alias("title"))


def standardized_tokens(name: Column) -> Column:
    """Tokens with resolutions in their usual form and language tags in canonical case."""
    def one(t: Column) -> Column:
        low = F.lower(t)
        out = F.when(low.rlike(r"^\d{3,4}p$"), low).when(low.isin("dual", "dubbed", "legendado"), F.initcap(low))
        for k, v in RESOLUTIONS.items():
            out = out.when(low == k, v)
        return out.otherwise(t)

    return F.array_join(F.transform(F.split(name, " "), one), " ")


RELEASE = r"(?i)^(.+?)[ .]\(?((?:19|20)\d{2})\)?[ .](\d{3,4}p|[248]k)(?:[ .]([A-Za-z]+))?$"


def release_parts(name: Column) -> Column:
    """(title, year, resolution, language); null where the name does not fit."""
    g = lambda i: F.nullif(F.regexp_extract(name, RELEASE, i), F.lit(""))
    return F.when(name.rlike(RELEASE), F.struct(F.replace(g(1), F.lit("."), F.lit(" ")).alias("title"), g(2).cast("int").alias("year"), F.lower(g(3)).alias("resolution"), g(4).alias("language")))


def season_episode(name: Column) -> Column:
    """(season, episode), two digits each: ``S02E05``, ``Season 2``, ``S01.``, ``E05``, else a number alone as the episode."""
    g = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    both = r"(?i)s(\d{1,2})e(\d{1,3})"
    season = F.coalesce(g(both, 1), g(r"(?i)season[ ._]?(\d{1,2})", 1), g(r"(?i)(?:^|[ ._])s(\d{1,2})(?:[ ._]|$)", 1))
    episode = F.coalesce(g(both, 2), g(r"(?i)(?:^|[ ._])e(\d{1,3})(?:[ ._]|$)", 1), g(r"^(\d{1,3})$", 1))
    pad = lambda c: F.lpad(c, F.greatest(F.lit(2), F.length(c)), F.lit("0"))
    return F.struct(pad(season).alias("season"), pad(episode).alias("episode"))


def normalized_resolution(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda c, kv: F.when(low == kv[0], kv[1]).otherwise(c), RESOLUTIONS.items(), low)


def resolution_order(text: Column) -> Column:
    return F.regexp_extract(normalized_resolution(text), r"(\d+)", 1).cast("int")


def height_bucket(height: Column) -> Column:
    return F.when(height >= 2160, 2160).when(height >= 1080, 1080).when(height >= 720, 720).otherwise(480)


def name_change(old: Column, new: Column) -> Column:
    """What a renaming did, joined by ``" + "``."""
    a, b, year = F.split(F.lower(old), " "), F.split(F.lower(new), " "), r"\b(19|20)\d{2}\b"
    tags = F.array(
        F.when(new.rlike(year) & ~old.rlike(year), "Add Year"),
        F.when(F.regexp_extract(F.lower(old), r"\d{3,4}p", 0) != F.regexp_extract(F.lower(new), r"\d{3,4}p", 0), "Correct Resolution"),
        F.when((F.size(a) > F.size(b)) & (F.size(F.array_distinct(a)) == F.size(F.array_distinct(b))), "Remove Duplicate Tokens"),
        F.when((F.array_sort(a) == F.array_sort(b)) & (a != b), "Reorder Tokens"),
        F.when((F.lower(old) == F.lower(new)) & (old != new), "Standardize Casing"),
    )
    return F.array_join(F.array_compact(tags), " + ")


def repositioned_tokens(name: Column) -> Column:
    """Special tokens moved behind the resolution, else behind the last year, else to the end."""
    tokens = F.split(name, " ")
    special, rest = F.filter(tokens, lambda t: F.upper(t).isin(SPECIAL)), F.filter(tokens, lambda t: ~F.upper(t).isin(SPECIAL))
    places = lambda p: F.filter(F.transform(rest, lambda t, i: F.when(t.rlike(p), i + 1)), lambda i: i.isNotNull())
    at = F.coalesce(F.array_min(places(r"(?i)^(\d{3,4}p|[248]k)$")), F.array_max(places(r"^\(?(19|20)\d{2}\)?$")), F.size(rest))
    return F.array_join(F.concat(F.slice(rest, F.lit(1), at), special, F.slice(rest, at + 1, F.size(rest))), " ")


def normalized_url(url: Column) -> Column:
    """Without fragment and tracking parameters."""
    bare = F.substring_index(url, "#", 1)
    query = F.when(bare.contains("?"), F.substring(bare, F.locate("?", bare) + 1, F.length(bare))).otherwise("")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})=")), "&")
    return F.concat(F.substring_index(bare, "?", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that is found."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def formatted_size(size: Column) -> Column:
    """Two decimals and a unit by powers of 1024."""
    out = F.format_string("%.2f PB", size / F.lit(1024.0**5))
    for i in range(4, -1, -1):
        out = F.when(size < 1024.0 ** (i + 1), F.format_string(f"%.2f {UNITS[i]}", size / F.lit(1024.0**i))).otherwise(out)
    return out


def formatted_duration(seconds: Column) -> Column:
    """``1d 2h 3m``, without the parts that are 0; ``0m`` for less than a minute."""
    d, h, m = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60
    part = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u)))
    text = F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"))
    return F.when(text == "", "0m").otherwise(text)


def clock(ms: Column) -> Column:
    """HH:MM:SS.mmm."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def clock_ms(text: Column) -> Column:
    """``m:ss`` and ``h:mm:ss`` in milliseconds, ``+00h00m01s0500ms`` with its sign; null for other texts."""
    parts = F.split(text, ":")
    plain = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 60 + x.cast("long")) * 1000
    g = lambda i: F.regexp_extract(text, r"^([+-])(\d+)h(\d+)m(\d+)s(\d+)ms$", i)
    n = lambda i: g(i).cast("long")
    signed = F.when(g(1) == "-", -1).otherwise(1) * (((n(2) * 60 + n(3)) * 60 + n(4)) * 1000 + n(5))
    return F.when(text.rlike(r"^\d+(:\d{2}){1,2}$"), plain).when(text.rlike(r"^[+-]\d+h\d+m\d+s\d+ms$"), signed)


def parsed_time(text: Column, now: Column) -> Column:
    """Epoch digits, ``3 h``, ``2 d``, ``1 w``, today, yesterday or an ISO date or time; null for other texts."""
    n = F.regexp_extract(text, r"^(\d+)\s*([hdw])$", 1).cast("int")
    unit = F.regexp_extract(text, r"^(\d+)\s*([hdw])$", 2)
    hours = n * F.when(unit == "h", 1).when(unit == "d", 24).otherwise(168)
    today = F.date_trunc("DAY", now)
    return (
        F.when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(text.cast("long")).cast("timestamp_ntz"))
        .when(text.rlike(r"^\d+\s*[hdw]$"), now - F.make_dt_interval(hours=hours))
        .when(F.lower(text) == "today", today).when(F.lower(text) == "yesterday", today - F.expr("interval 1 day"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    )


def plain_lines(text: Column) -> Column:
    """Without ANSI codes and tags; runs of blank lines are one; no double space before ``#``."""
    steps = [(r"\x1b\[[0-9;]*m", ""), (r"<[^>]*>", ""), (r" {2,}#", " #"), (r"\n{3,}", "\n\n")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def squeezed_lines(text: Column) -> Column:
    """Lines squeezed; empty ones and immediate repeats dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    joined = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) == x, a).otherwise(F.array_append(a, x)))
    return F.array_join(joined, "\n")


def between(text: Column, start: str, end: str) -> Column:
    """From the first start marker to the end of the first end marker after it; null where either is missing."""
    a = F.locate(start, text)
    rest = F.substring(text, a, F.length(text))
    b = F.locate(end, rest)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b + len(end) - 1))


def derived_title(text: Column, ignored: list[str], fallback: Column, most: int = 160) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(ignored))
    return F.coalesce(F.left(F.get(lines, 0), F.lit(most)), fallback)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, cut to 24 hex digits."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(24))


def language_of_alias(text: Column) -> Column:
    """The code of an alias that the text is, holds as a word, or (of three letters or more) holds anywhere: in this order."""
    low, words = F.lower(text), F.split(F.lower(text), r"[^a-z]+")
    exact = [F.when(low.isin(a), k) for k, a in LANGUAGES.items()]
    word = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, a))), k) for k, a in LANGUAGES.items()]
    part = [F.when(reduce(lambda x, y: x | y, [low.contains(x) for x in a if len(x) >= 3]), k) for k, a in LANGUAGES.items()]
    return F.coalesce(*exact, *word, *part)


def file_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"[;,\s]+", ";"), ";"), lambda x: x != "")


def without_index_and_size(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d+\.\s+", ""), r"\s+\d+(\.\d+)?\s?[KMGT]B$", ""))


def without_parentheses(text: Column) -> Column:
    """Without ``(…)`` groups and emoji."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", ""))


def path_parts(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    name = F.substring_index(p, "/", -1)
    return F.struct(
        F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"),
        F.when(p.contains("/"), F.substring(p, F.lit(1), F.length(p) - F.length(name) - 1)).otherwise("").alias("parent"), F.substring_index(p, "/", 1).alias("first"),
    )


def is_descriptive(phrase: Column, phrases: list[str], keywords: list[str], allowed: list[str]) -> Column:
    """No digit, and either a listed phrase or up to five allowed words with a keyword among them."""
    words = F.split(normalized_title(phrase), " ")
    few = (F.size(words) <= 5) & F.arrays_overlap(words, F.array(*map(F.lit, keywords))) & F.forall(words, lambda w: w.isin([*allowed, *keywords]))
    return ~phrase.rlike(r"\d") & (normalized_title(phrase).isin(phrases) | few)


def without_descriptive_fragments(text: Column, phrases: list[str], keywords: list[str], allowed: list[str]) -> Column:
    """``[…]`` and ``(…)`` fragments of up to 80 characters removed where they are descriptive; lines of music signs emptied."""
    fragments = F.regexp_extract_all(text, F.lit(r"[\[(][^\])]{1,80}[\])]"), 0)
    gone = F.filter(fragments, lambda f: is_descriptive(F.regexp_replace(f, r"[\[\]()]", ""), phrases, keywords, allowed))
    left = F.aggregate(gone, text, lambda t, f: F.replace(t, f, F.lit("")))
    return F.when(left.rlike(r"^[\s♪♫]*$"), "").otherwise(F.trim(F.regexp_replace(left, r"\s{2,}", " ")))


def tag_family(stem: Column) -> Column:
    """The stem without generated suffixes, however many."""
    return F.regexp_replace(stem, r"((_[a-z]{2})|(\.cleaned)|(\.synced))+$", "")
