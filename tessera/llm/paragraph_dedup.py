"""Near-duplicate paragraphs across documents: MinHash bands, exact Jaccard check, components.

A paragraph is a line of at least ``MIN_WORDS`` words, or neighbouring shorter lines joined until they have as many;
its set is its 5-word shingles. ``BANDS`` bands of ``ROWS`` MinHash values let two paragraphs of similarity 0.8 meet
with probability 0.999. Colliding ones whose sizes and one-bit sketches allow it are compared exactly. In a band of
many paragraphs only those that meet in a longer band too (``FINE_BANDS`` of ``FINE_ROWS``) are compared at first, with
the one of them that meets most others; after components are formed, pairs of different components are compared
as well, where a larger sketch allows it, so no colliding pair is passed over.

Passages that stand verbatim in several places inside longer lines or over several short ones are found apart
from that, over the words of whole texts (``passages``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import passages
from tessera.llm.shared import LOWER, components, free_names, group_shingles, map_blocks, mix64, ragged, set_names, string_hashes, words_of, written

SHINGLE, PERCENT, MIN_WORDS = 5, 80, 10
BANDS, ROWS = 10, 3
#: Bits of the one-bit sketch. At similarity 0.8 a tenth of them differ, 12.8 of 128 with a deviation of 3.4:
#: the limit is over five deviations above.
SKETCH, MAX_DIFFERENT = 128, 32
#: Longest list of different sets in a band whose pairs are all compared at once.
SHORT_LIST = 8
#: Bands of the members of long lists, and their sketch: at similarity 0.8 102.4 of 1024 bits differ with a deviation
#: of 9.6; the limit is over four deviations above.
FINE_BANDS, FINE_ROWS = 30, 8
FINE_SKETCH, FINE_DIFFERENT = 1024, 142
#: Sets of a long list that are compared in one go with as many others.
LIST_BLOCK = 512
#: Names of sets that a task keeps, so as not to sign one again; tokens signed at once.
SEEN, PART = 500_000, 1 << 15
_RNG = np.random.default_rng(20)
_HASHES = BANDS * ROWS + SKETCH + FINE_BANDS * FINE_ROWS + FINE_SKETCH
_MULTIPLY = _RNG.integers(0, 2**31, _HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, _HASHES).astype(np.uint32)


def recall(similarity: float) -> float:
    """The probability that two paragraphs meet in a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def _joined(sizes: list[int], even: list[bool]) -> list[tuple[int, int]]:
    """Which of a row of short lines make a paragraph together: one ends, once it has ``MIN_WORDS``, after a line
    whose hash is even, or at four times as many words, so that equal lines part alike whatever stands before. What
    is left over goes to the last one; a row of fewer words in all is none."""
    out, begin, held = [], 0, 0
    for i, (size, stop) in enumerate(zip(sizes, even, strict=True)):
        held += size
        if held >= MIN_WORDS and (stop or held >= 4 * MIN_WORDS):
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    if held >= MIN_WORDS:
        out.append((begin, len(sizes)))
    elif held and out:
        out[-1] = out[-1][0], len(sizes)
    return out


def paragraphs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: (words, each text's first one) and (text, first line, lines, first word, words) of each paragraph."""
    low = LOWER[raw]
    start, end, first = words_of(low, bounds)
    words = string_hashes(low, start, end)
    feeds = (raw == 10).nonzero()[0]
    begin = np.sort(np.concatenate([feeds + 1, bounds[:-1]]), kind="stable")
    count = np.diff(np.searchsorted(feeds, bounds)) + 1
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
    word = np.searchsorted(start, np.append(begin, len(raw)))
    n = np.diff(word)
    total = np.append(np.uint64(0), np.cumsum(words))
    even = mix64(total[word[1:]] - total[word[:-1]], 9) & np.uint64(1) == 0
    long, short = (n >= MIN_WORDS).nonzero()[0], ((n > 0) & (n < MIN_WORDS)).nonzero()[0]
    found = [(i, i + 1) for i in long.tolist()]
    parts = ((np.diff(short) != 1) | (np.diff(text[short]) != 0)).nonzero()[0] + 1
    for row in np.split(short, parts):
        if len(row) and n[row].sum() >= MIN_WORDS:
            found += [(int(row[0]) + a, int(row[0]) + b) for a, b in _joined(n[row].tolist(), even[row].tolist())]
    a, b = np.array(sorted(found), np.int64).reshape(-1, 2).T
    return words, first, text[a], number[a], b - a, word[a], word[b] - word[a]


def paragraph_sets(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, bounds) of stretches of ``size`` words from ``first`` on."""
    to = np.append(0, np.cumsum(size))
    return group_shingles(words[np.repeat(first - to[:-1], size) + np.arange(to[-1])], to, SHINGLE)


def signatures(tokens: np.ndarray, bounds: np.ndarray, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, none empty, the keys of its (fine) bands, and its sketch as signed integers."""
    bands, rows, sketch, begin = (FINE_BANDS, FINE_ROWS, FINE_SKETCH, BANDS * ROWS + SKETCH) if fine else (BANDS, ROWS, SKETCH, 0)
    low = np.empty((bands * rows + sketch, len(bounds) - 1), np.uint32)
    tokens, a = (tokens >> np.uint64(32)).astype(np.uint32), 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PART, "right")) - 1)
        part, starts = tokens[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        for j in range(len(low)):
            low[j, a:b] = np.minimum.reduceat(part * _MULTIPLY[begin + j] + _ADD[begin + j], starts)
        a = b
    keys = np.empty((len(bounds) - 1, bands), np.uint64)
    for i in range(bands):
        key = np.full(len(bounds) - 1, i, np.uint64)
        for j in range(i * rows, (i + 1) * rows):
            key = mix64(key ^ low[j].astype(np.uint64), 1 + j)
        keys[:, i] = key
    bits = np.packbits(((low[bands * rows :] >> np.uint32(8)) & np.uint32(1)).astype(np.uint8), axis=0).T
    return keys.view(np.int64), np.ascontiguousarray(bits).view(">i8").astype(np.int64)


PARAGRAPHS = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("words", T.IntegerType()),
    T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
]))


def _paragraph_maker(verbatim: bool):
    import pyarrow as pa

    seen: set[int] = set()
    hasher = passages.Hasher()

    def work(raw, bounds):
        words, first, text, pos, lines, at, size = paragraphs(raw, bounds)
        tokens, of = paragraph_sets(words, at, size)
        names = set_names(tokens, of)
        if len(seen) > SEEN:
            seen.clear()
        new = np.zeros(len(names), bool)
        new[[i for name, i in zip(*(x.tolist() for x in np.unique(names, return_index=True)), strict=True) if name not in seen]] = True
        seen.update(names[new].tolist())
        n = np.diff(of)
        keys, sketch = signatures(tokens[np.repeat(new, n)], np.append(0, np.cumsum(n[new])))
        place = np.cumsum(new) - 1
        bands = ragged(keys.ravel(), np.append(0, np.cumsum(new * BANDS)), pa.int64(), ~new)
        halves = [pa.array(sketch[place, i] if len(sketch) else np.zeros(len(names), np.int64), pa.int64(), mask=~new) for i in (0, 1)]
        columns = [pa.array(x.astype(np.int32), pa.int32()) for x in (pos, lines, at - first[text], size)]
        columns += [pa.array(names, pa.int64()), pa.array(n.astype(np.int32), pa.int32()), bands, *halves]
        rows = pa.StructArray.from_arrays(columns, names=PARAGRAPHS.elementType.names)
        found = [pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(bounds))).astype(np.int32)), rows)]
        return None, [*found, passages.stretches(words, first, hasher)] if verbatim else found

    return work


def _near() -> Column:
    """Whether sizes and sketches of a and b allow the similarity."""
    different = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & (different <= MAX_DIFFERENT)


def _token_sets(wanted: DataFrame, occurrences: DataFrame, docs: DataFrame, fine: bool = False) -> DataFrame:
    """(set, tokens) of the wanted sets, read again from one text each; if ``fine``, with (keys, bits) too."""
    import pyarrow as pa

    places = occurrences.join(wanted, "set", "left_semi").groupBy("set").agg(F.min(F.struct("text_key", "pos", "lines")).alias("at"))
    place = F.struct("set", F.col("at.pos").alias("pos"), F.col("at.lines").alias("lines"))
    by_text = places.groupBy(F.col("at.text_key").alias("text_key")).agg(F.collect_set(place).alias("places"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(by_text, "text_key")
    split = F.split("text", "\n")
    cut = lambda p: F.struct(p["set"].alias("set"), F.array_join(F.slice(split, p["pos"] + 1, p["lines"]), "\n").alias("lines"))
    lines = texts.select(F.explode(F.transform("places", cut)).alias("p")).select("p.set", "p.lines")

    def make():
        def work(raw, bounds):
            low = LOWER[raw]
            start, end, first = words_of(low, bounds)
            tokens, of = group_shingles(string_hashes(low, start, end), first, SHINGLE)
            found = [set_names(tokens, of), ragged(tokens.view(np.int64), of, pa.int64())]
            more = signatures(tokens, of, True) if fine else ()
            return None, [*found, *(ragged(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.int64()) for x in more)]

        return work

    fields = [T.StructField("own", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ["tokens", "keys", "bits"][: 1 + 2 * fine]]]
    found = map_blocks(lines, "lines", ["set"], fields, make).where("set = own").drop("own").dropDuplicates(["set"])
    return written(found, "paragraph-sets")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the threshold."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.where(common * (100 + PERCENT) >= (F.size("tokens_a") + F.size("tokens_b")) * PERCENT).select("a", "b")


def _lone_tokens(sets: DataFrame) -> DataFrame:
    """(set, lone): how many of a set's tokens none of the other sets has."""
    each = sets.select("set", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("set").alias("set"))
    return each.where("n = 1").groupBy("set").agg(F.count("*").alias("lone"))


def _side(rows: DataFrame, side: str, key: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in (key, *more)])


def paragraph_links(occurrences: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different paragraph sets. ``sets``: (set, n, bands, s1, s2), a set perhaps several times."""
    postings = sets.select("set", F.explode("bands").alias("key"))
    lists = postings.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("key")
    met = written(postings.join(lists, "key", "left_semi").distinct(), "bands")
    sizes = met.groupBy("key").agg((F.count("*") > SHORT_LIST).alias("long"))
    shared = written(met.join(sizes, "key"), "bands")
    attributes = written(sets.join(shared.select("set").distinct(), "set", "left_semi").select("set", "n", "s1", "s2").dropDuplicates(["set"]), "sketches")

    def allowed(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(_side(attributes, side, "set"), side)
        return pairs.where(_near()).select("a", "b")

    short, long = shared.where("not long").select("key", "set"), shared.where("long").select("key", "set")
    pairs = short.withColumnRenamed("set", "a").join(short.withColumnRenamed("set", "b"), "key").where("a < b").select("a", "b").distinct()
    members = _token_sets(long.select("set").distinct(), occurrences, docs, fine=True)
    first = written(allowed(pairs.union(_stars(members)).distinct()), "paragraph-pairs")
    ends = first.select(F.col("a").alias("set")).union(first.select("b")).distinct()
    links = written(_compared(first, _token_sets(ends, occurrences, docs)), "paragraph-links")
    return written(links.union(_compared(_late_pairs(long, members, components(links)), members)), "paragraph-links")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each fine band's members with the one of them that meets most others."""
    met = members.select("set", F.explode("keys").alias("key"))
    lists = met.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("key")
    met = written(met.join(lists, "key", "left_semi"), "fine-bands")
    degrees = met.groupBy("set").agg(F.count("*").alias("degree"))
    pivots = written(met.join(degrees, "set").groupBy("key").agg(F.max(F.struct("degree", "set")).alias("p")).select("key", F.col("p.set").alias("pivot")), "band-pivots")
    return met.join(pivots, "key").where("pivot <> set").select(F.least("pivot", "set").alias("a"), F.greatest("pivot", "set").alias("b"))


def _late_pairs(long: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a long list's members in different components that their fine sketches and common tokens allow."""
    groups = groups.select(F.col("node").alias("set"), "root")
    placed = written(long.join(groups, "set", "left").select("key", "set", F.coalesce("root", "set").alias("group")), "long-bands")
    mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("k")).where("low <> high")
    placed = placed.join(mixed.select("key", F.ceil(F.col("k") / LIST_BLOCK).cast("int").alias("blocks")), "key")
    # What no other of these sets has, no pair of them can share: it bounds each one's common part.
    members = members.join(placed.select("set").distinct(), "set", "left_semi")
    n = F.size("tokens")
    bounds = members.join(_lone_tokens(members), "set", "left").select("set", "bits", n.alias("n"), (n - F.coalesce("lone", F.lit(0))).alias("most"))
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).join(bounds, "set"), "late-bands")
    # Every block of a list meets every other one, and itself, in a group of its own.
    a = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("block", "blocks")
    b = placed.withColumnRenamed("block", "other").drop("blocks")
    reach = F.least("most_a", "most_b") * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    different = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(FINE_SKETCH // 64)), F.lit(0))
    apart = (F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b"))
    late = _side(a, "a", "set", "key", "other").join(_side(b, "b", "set", "key", "other"), ["key", "other"]).where(apart & size & reach & (different <= FINE_DIFFERENT))
    return written(late.select("a", "b").distinct(), "late-pairs")


def _passages(read: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text_key, hit): passages' places in the texts; a place that shares words with a line that left is lost."""
    left = hits.where("item is not null").groupBy(F.col("doc").alias("_doc"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("word", "words")).alias("ranges"))
    each = read.join(left, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    each = each.select("doc", "text_key", "ranges", F.explode("stretches").alias("s"))
    lost = F.exists("ranges", lambda r: (r["word"] < F.col("s.start") + F.col("s.n") + (passages.PASSAGE - 1)) & (r["word"] + r["words"] > F.col("s.start")))
    each = each.select("doc", "text_key", F.coalesce(lost.cast("int"), F.lit(0)).alias("lost"), "s.*")
    words = (F.col("n") + (passages.PASSAGE - 1)).alias("words")
    return passages.passage_hits(each, docs).select("doc", "text_key", F.struct(F.col("start").alias("word"), words, "gone").alias("hit"))


def remove_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """``docs`` with n_paragraphs, n_near, n_removed, removed and kept_text; if ``verbatim``, n_repeated and cut too.

    ``n_near`` counts a text's paragraphs that have a near-equal one in another place, ``n_removed`` those of them that
    leave: of each component the one of smallest id, then smallest line, stays. ``removed`` names them: (line, lines,
    first_doc, first_line). Null, empty and blank texts have no paragraphs, nor has a row of short lines of fewer
    than ``MIN_WORDS`` words in all; repeated rows with equal id and text get equal results; a null id comes before
    all others. Columns named like the added ones are replaced, others pass.

    With ``verbatim``, passages of ``passages.PASSAGE`` words or more that stand in another place too leave as well,
    inside lines and over several of them; ``cut`` has the runs of words (word, words) that leave. A passage's first
    place is the first of those that no paragraph left; a copy that overlaps it stays. ``n_repeated`` counts the runs of
    that many words or more which stand elsewhere as well, verbatim or as near-equal paragraphs, first places included.
    """
    added = ["n_paragraphs", "n_near", "n_removed", "removed", "kept_text", *["n_repeated", "cut"] * verbatim]
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    fields = [T.StructField("paragraphs", PARAGRAPHS), T.StructField("stretches", passages.STRETCHES)]
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    read = written(map_blocks(rows, "text", ["doc", "text_key"], fields[: 1 + verbatim], lambda: _paragraph_maker(verbatim)), "paragraphs")
    each = read.select("doc", "text_key", F.explode("paragraphs").alias("p")).select("doc", "text_key", "p.*")
    occurrences = each.select("doc", "text_key", "pos", "lines", "set", "word", "words")
    links = paragraph_links(occurrences, each.where("bands is not null").select("set", "n", "bands", "s1", "s2"), rows.select("text"))
    groups = components(links).select(F.col("node").alias("set"), "root")
    placed = occurrences.join(groups, "set", "left").withColumn("root", F.coalesce("root", "set"))
    firsts = written(placed.groupBy("root").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"), "first-paragraphs")
    gone = ~F.struct("doc", "pos").eqNullSafe(F.col("first"))
    item = F.struct(
        F.col("pos").cast("long").alias("line"), F.col("lines").cast("long").alias("lines"),
        F.col("first.doc").alias("first_doc"), F.col("first.pos").cast("long").alias("first_line"),
    )
    hits = placed.join(firsts, "root").select("doc", "text_key", "pos", "word", "words", F.when(gone, item).alias("item"))
    if verbatim:
        hits = written(hits, "paragraph-hits")
        hits = hits.unionByName(_passages(read, hits, rows.select("text")), allowMissingColumns=True)
        wide = F.struct("word", "words", F.lit(None).cast("boolean").alias("gone"))
        hits = hits.withColumn("hit", F.coalesce("hit", F.when(F.col("words") >= passages.PASSAGE, wide)))
    sizes = read.select("doc", "text_key", F.size("paragraphs").alias("paragraphs"))
    by_text = hits.unionByName(sizes, allowMissingColumns=True).groupBy("doc", "text_key").agg(
        F.max("paragraphs").alias("paragraphs"), F.collect_set("item").alias("gone"), F.count_distinct("pos").alias("near"), *[F.collect_set("hit").alias("hits")] * verbatim
    )
    if verbatim:
        by_text = passages.merged(by_text)
    by_text = written(by_text, "repeated-by-text")
    names = dict(zip(by_text.columns, free_names([*docs.columns, *added], *by_text.columns), strict=True))
    doc, key, size, left, near = (F.col(names[c]) for c in ("doc", "text_key", "paragraphs", "gone", "near"))
    split = F.split(F.col(text_col), "\n")
    lines = F.flatten(F.transform(left, lambda r: F.sequence(r["line"], r["line"] + r["lines"] - 1)))
    lines = F.when(F.size(left) > 0, F.transform(lines, lambda i: i.cast("int")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), lines)
    by_text = by_text.select(*[F.col(c).alias(name) for c, name in names.items()])
    joined = docs.join(by_text, F.col(id_col).eqNullSafe(doc) & F.xxhash64(text_col).eqNullSafe(key), "left")
    kept_text = F.when(lines.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    more = {}
    if verbatim:
        spans = F.col(names["spans"])
        inside = F.coalesce(F.size(spans), F.lit(0)) > 0
        args = [F.when(inside, x) for x in (F.col(text_col), lines, spans)]
        kept_text = F.when(inside, F.udf(passages.cut, "string", useArrow=True)(*args)).otherwise(kept_text)
        more = {"n_repeated": F.col(names["runs"]), "cut": F.coalesce(spans, F.array())}
    return joined.withColumns({
        "n_paragraphs": size.cast("long"), "n_near": near, "n_removed": F.size(left).cast("long"), "removed": F.array_sort(left), "kept_text": kept_text,
    } | more).drop(*names.values())
