"""Exact removal of long byte strings that occur more than once, by blockwise suffix sorting.

A string of ``LENGTH`` bytes holds the gram of least hash among its grams, its anchor, wherever it stands.
So suffixes need to be sorted only against those that share an anchor: a suffix bucket. Anchors that occur
once are left out; for the others a document gives the stretch that its strings with this anchor span.

A task takes its buckets in blocks of bounded size, one after another. Stretches are laid out with their
anchors at a multiple of ``PERIOD``; the suffixes at the positions of a difference cover modulo ``PERIOD``
are ranked first, by doubling. A string is then ordered by its few bytes before the next cover position and
the rank there, which settles ties of any depth; neighbours that agree in ``LENGTH`` bytes are repeats.

Anchors of very many places give their strings one by one, each as a bucket of its own that a task combines
before the shuffle, so that no bucket grows with the input.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free_names, give_back, map_texts, mix64, small_batches, text_blocks, written

LENGTH, GRAM = 200, 96
WINDOW = LENGTH - GRAM + 1
#: A difference cover of the residues: any two have a shift that takes both into it; no gap above 8.
PERIOD, COVER = 32, (0, 1, 2, 4, 8, 13, 18, 24)
#: Places of an anchor from which its strings go one by one; bytes of a block.
HOT, BLOCK_BYTES = 1000, 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = mix64(np.arange(256, dtype=np.uint64))
#: Bytes hashed at once: bounds the memory that a long text takes, and what short ones take together.
PART, SHORT_TEXTS = 1 << 20, 1 << 18
#: Strings of hot anchors that a task keeps, to combine equal ones before the shuffle.
HOT_KEPT = 100_000


def _powers(n: int, odd: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, odd), out=out[1:])
    return out


class Hasher:
    """Hashes of all strings of some size in an array of bytes or of hashes, modulo 2^64, mixed."""

    def __init__(self) -> None:
        self.up = _powers(1 << 16, _BASE)
        self.down = _powers(1 << 16, np.uint64(pow(int(_BASE), -1, 1 << 64)))

    def __call__(self, data: np.ndarray, size: int) -> np.ndarray:
        n = len(data)
        while len(self.up) < n + 1:
            self.up, self.down = _powers(2 * len(self.up), _BASE), _powers(2 * len(self.down), self.down[1])
        total = np.zeros(n + 1, np.uint64)
        values = _BYTES[data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64))
        values *= self.up[:n]
        np.cumsum(values, out=total[1:])
        out = total[size:] - total[: n - size + 1]
        out *= self.down[: n - size + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = best(out[:-have], out[have:]), have * 2
    return best(out[: len(values) - width + 1], out[width - have : len(values) - have + 1])


def anchors(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, place, hash) of each run of string starts start..end-1 that share the anchor at ``place``."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(data) - LENGTH + 1, PART):
        part = data[at : at + PART + LENGTH - 1]
        h = hasher(part, GRAM)
        low = _slide(h, WINDOW, np.minimum)
        pad = np.zeros(WINDOW - 1, np.uint64)
        places = (h == _slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum)).nonzero()[0]
        starts = np.arange(len(low))
        nearest = np.searchsorted(places, starts)
        while len(off := (h[places[nearest]] != low).nonzero()[0]):
            nearest[off] += 1
        first = np.append(True, nearest[1:] != nearest[:-1]).nonzero()[0]
        place = places[nearest[first]]
        for o, x in zip(out, (first + at, np.append(first[1:], len(low)) + at, place + at, h[place]), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def text_anchors(raw: np.ndarray, bounds: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(text, start, end, place, hash) of the anchors of several texts, places counted from each one's begin."""
    if len(raw) > PART:
        each = [anchors(raw[a:b], hasher) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.repeat(np.arange(len(each)), [len(x[0]) for x in each]), *(np.concatenate(c) for c in zip(*each, strict=True))
    text = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - LENGTH + 1, 0))
    n = np.bincount(text, minlength=len(bounds) - 1)
    starts = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
    if not len(starts):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = hasher(raw, GRAM)
    low = _slide(h, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    places = (h == _slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum)).nonzero()[0]
    low = low[starts]
    nearest = np.searchsorted(places, starts)
    while len(off := (h[places[nearest]] != low).nonzero()[0]):
        nearest[off] += 1
    new = np.append(True, (nearest[1:] != nearest[:-1]) | (text[1:] != text[:-1])).nonzero()[0]
    last = np.append(new[1:], len(starts)) - 1
    of, place = text[new], places[nearest[new]]
    return of, starts[new] - bounds[of], starts[last] + 1 - bounds[of], place - bounds[of], h[place]


def repeats_in_block(stretches: list[bytes], places: np.ndarray, runs: np.ndarray, buckets: np.ndarray) -> list[np.ndarray]:
    """Per stretch, which of its first ``runs`` strings another place of its bucket has too."""
    sizes = np.array([len(s) for s in stretches])
    begins, at = np.empty(len(stretches), np.int64), 0
    for i, (size, place) in enumerate(zip(sizes.tolist(), places.tolist(), strict=True)):
        at += -(at + place) % PERIOD
        begins[i] = at
        at += size
    text = np.zeros(at + 2 * LENGTH + 64, np.uint8)
    for b, s in zip(begins.tolist(), stretches, strict=True):
        text[b : b + len(s)] = np.frombuffer(s, np.uint8)
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    # Ranks of the cover's suffixes by their first 32, 64, 128 and 256 bytes.
    n = at + LENGTH
    cover = np.concatenate([np.arange(c, n, PERIOD) for c in COVER])
    cover.sort()
    step = 8
    keys = [words[np.minimum(cover + k * step, len(words) - 1)].astype(np.uint64) for k in range(PERIOD // step)]
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    for k in keys:
        changed[1:] |= k[order][1:] != k[order][:-1]
    rank = np.zeros(n + 2 * LENGTH + 64, np.int64)
    rank[cover[order]] = np.cumsum(changed) + 1
    ranks = {PERIOD: rank}
    depth = PERIOD
    while depth < 256:
        key = rank[cover] * np.int64(len(cover) + 2) + rank[np.minimum(cover + depth, len(rank) - 1)]
        rank = np.zeros_like(rank)
        rank[cover] = np.unique(key, return_inverse=True)[1] + 1
        depth *= 2
        ranks[depth] = rank
    # Strings, by bucket and place in relation to the anchor, then their head, then the rank where the cover begins.
    string = np.concatenate([np.arange(b, b + r) for b, r in zip(begins.tolist(), runs.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(stretches)), runs)
    group = buckets[owner] * (WINDOW + 1) + (begins + places)[owner] - string
    gap = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])[string % PERIOD]
    head = words[string].astype(np.uint64)
    masks = np.array([((1 << (8 * g)) - 1) << (64 - 8 * g) for g in range(9)], np.uint64)
    entry = string + gap
    order = np.lexsort((ranks[256][entry], head & masks[gap], group))
    a, b = order[:-1], order[1:]
    # The next 192 bytes after the gap of at most 8, and the words at either end: 200 bytes in all.
    same = (group[a] == group[b]) & (head[a] == head[b]) & (ranks[128][entry[a]] == ranks[128][entry[b]])
    same &= (ranks[64][entry[a] + 128] == ranks[64][entry[b] + 128]) & (words[string[a] + LENGTH - 8] == words[string[b] + LENGTH - 8])
    hit = np.zeros(len(string), bool)
    hit[a[same]] = hit[b[same]] = True
    return np.split(hit, np.cumsum(runs)[:-1])


def _spans(starts: np.ndarray, flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of bytes that the flagged strings cover, neighbouring ones as one."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(int(starts[a]), int(starts[b - 1]) + LENGTH) for a, b in zip((edge == 1).nonzero()[0], (edge == -1).nonzero()[0], strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _text_key() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(0x5EED), "text")


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(hash, k1, place) of each anchor of each text; a text that a task has seen is passed over."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        hasher, seen = Hasher(), set()
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
            new = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            k1, data = batch.column(0).take(pa.array(new, pa.int64())).to_numpy(), batch.column(2).take(pa.array(new, pa.int64()))
            for a, _, raw, bounds in text_blocks(data, SHORT_TEXTS):
                of, _, _, place, h = text_anchors(raw, bounds, hasher)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1[a + of]), pa.array(place)], names=["hash", "k1", "place"])
        give_back()

    k1, k2 = _text_key()
    long = docs.select(k1.alias("k1"), k2.alias("k2"), F.encode("text", "UTF-8").alias("data")).where(F.length("data") >= LENGTH)
    return long.mapInArrow(run, "hash long, k1 long, place long")


def _stretches(marked: DataFrame) -> DataFrame:
    """Texts with their repeated anchors: (bucket, k1, k2, start, place, runs, bytes) to be sorted, and spans known already (runs 0)."""
    small_batches(marked.sparkSession)

    step = 1 << 40

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("bucket", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("runs", pa.int64()), ("bytes", pa.binary())])
        hasher, last = Hasher(), None
        hot_seen: dict[tuple[int, bytes], tuple | None] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
            new = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else last)]  # they come sorted
            last = keys[-1] if keys else last
            data, marks = (batch.column(i).take(pa.array(new, pa.int64())) for i in (2, 3))
            for a, b, raw, bounds in text_blocks(data, SHORT_TEXTS):
                part = marks.slice(a, b - a)
                known = np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy()) * step + part.flatten().field("place").to_numpy()
                order = np.argsort(known)
                known, hots = known[order], part.flatten().field("hot").to_numpy(zero_copy_only=False)[order]
                of, start, end, place, h = text_anchors(raw, bounds, hasher)
                at = np.minimum(np.searchsorted(known, of * step + place), max(0, len(known) - 1))
                mine = (known[at] == of * step + place).nonzero()[0] if len(known) else at[:0]
                text, rows = raw.tobytes(), []
                columns = (of[mine], start[mine], end[mine], place[mine], h[mine].view(np.int64), hots[at[mine]], bounds[of[mine]])
                for i, s, e, p, g, hot, begin in zip(*(c.tolist() for c in columns), strict=True):
                    k1, k2 = keys[new[a + i]]
                    if not hot:
                        rows.append((g, k1, k2, s, p - s, e - s, text[begin + s : begin + e - 1 + LENGTH]))
                        continue
                    for w in range(s, e):
                        string = text[begin + w : begin + w + LENGTH]
                        key = (g, string)
                        if key not in hot_seen:
                            if len(hot_seen) >= HOT_KEPT:
                                hot_seen.clear()
                            hot_seen[key] = (k1, k2, w)
                            rows.append((xxhash.xxh3_64_intdigest(string) - (1 << 63), k1, k2, w, p - w, 1, string))
                        else:  # another place of this task has it: both are repeats
                            rows.append((0, k1, k2, w, 0, 0, b""))
                            if (other := hot_seen[key]) is not None:
                                rows.append((0, *other, 0, 0, b""))
                                hot_seen[key] = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return marked.select("k1", "k2", "data", "marks").mapInArrow(run, "bucket long, k1 long, k2 long, start long, place long, runs long, bytes binary")


def _sorted_blocks(stretches: DataFrame) -> DataFrame:
    """Spans (k1, k2, start, end) of repeated strings, bucket by bucket."""

    def run(batches):
        import pyarrow as pa

        def solve(rows):
            # Equal stretches of a bucket are repeats as they stand; one of them stands for all in the sort,
            # and a bucket of a single distinct stretch needs none.
            distinct: dict[tuple, list[int]] = {}
            for i, r in enumerate(rows):
                distinct.setdefault((r[0], r[4], r[6]), []).append(i)
            several = Counter(bucket for bucket, _, _ in distinct)
            hits = {members[0]: np.ones(rows[members[0]][5], bool) for members in distinct.values() if len(members) > 1}
            some = [members[0] for (bucket, _, _), members in distinct.items() if several[bucket] > 1]
            if some:
                buckets = np.unique([rows[i][0] for i in some], return_inverse=True)[1]
                found = repeats_in_block([rows[i][6] for i in some], np.array([rows[i][4] for i in some]), np.array([rows[i][5] for i in some]), buckets)
                for i, hit in zip(some, found, strict=True):
                    hits[i] = hits[i] | hit if i in hits else hit
            out = []
            for members in distinct.values():
                if (hit := hits.get(members[0])) is not None and hit.any():
                    for r in map(rows.__getitem__, members):
                        out += [(r[1], r[2], *span) for span in _spans(np.arange(r[3], r[3] + r[5]), hit)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "end"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)
        give_back()

    dealt = stretches.where("runs > 0").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "k1 long, k2 long, start long, end long")


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with spans: array of (start, end), the bytes of each text to remove, sorted and merged.

    A byte goes when a string of ``LENGTH`` bytes over it starts anywhere else too, in the same text or another
    row, equal rows included; the input decides, not what is left. Null and shorter texts have no spans.
    A column called spans is replaced.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    places = written(_anchor_rows(texts), "anchors")
    one = F.xxhash64("k1", "place")
    repeated = places.groupBy("hash").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n")).where("low <> high")
    repeated = written(repeated.select("hash", (F.col("n") > HOT).alias("hot")), "repeated-anchors")
    marks = places.join(repeated, "hash").groupBy("k1").agg(F.collect_set(F.struct("place", "hot")).alias("marks"))
    marks = written(marks, "marks")
    k1, k2 = _text_key()
    keyed = texts.select("text", k1.alias("k1"), k2.alias("k2"))
    marked = keyed.join(marks, "k1").sortWithinPartitions("k1", "k2").withColumn("data", F.encode("text", "UTF-8"))
    stretches = written(_stretches(marked), "stretches")
    known = stretches.where("runs = 0").select("k1", "k2", "start", (F.col("start") + LENGTH).alias("end"))
    copies = keyed.where(F.octet_length("text") >= LENGTH).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    whole = copies.select("k1", "k2", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    spans = _sorted_blocks(stretches).unionByName(known).unionByName(whole)
    kept = [c for c in docs.columns if c != "spans"]
    one, two, mine = free_names(kept, "k1", "k2", "found")
    spans = spans.groupBy(F.col("k1").alias(one)).agg(F.collect_set(F.struct("k2", "start", "end")).alias(mine))
    spans = written(spans, "repeated-spans")
    base = docs.select(*kept, F.xxhash64(text_col).alias(one), F.xxhash64(F.lit(0x5EED), F.col(text_col)).alias(two))
    found = base.join(spans, one, "left")
    own = F.filter(mine, lambda s: (s["k2"] == F.col(two)) & F.col(text_col).isNotNull())
    end = lambda s: F.when(s["end"] < 0, F.octet_length(text_col).cast("long")).otherwise(s["end"])
    sorted_spans = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), end(s).alias("end"))))
    return found.select(*kept, F.coalesce(sorted_spans, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def _cutter():
    def work(rows):
        spans = [merged([(s["start"], s["end"]) for s in r["spans"]]) for r in rows]
        kept = []
        for r, cut in zip(rows, spans, strict=True):
            data, at, parts = r["data"] or b"", 0, []
            for s, e in cut:
                parts.append(data[at:s])
                at = e
            kept.append(b"".join([*parts, data[at:]]))
        return [[sum(e - s for s, e in cut) for cut in spans], [len(cut) for cut in spans], kept]

    return work


def remove_repeats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, n_bytes, n_removed, n_spans and kept (binary: a cut may part a character)."""
    from pyspark.sql import types as T

    keep = [c for c in keep if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    found = repeated_spans(docs, text_col)
    (row,) = free_names([*keep, "n_bytes"], "row")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = found.select(*keep, F.length(data).cast("long").alias("n_bytes"), F.struct(data.alias("data"), "spans").alias(row))
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    return map_texts(rows, row, [*keep, "n_bytes"], fields, _cutter)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return remove_repeats(docs, [id_col], text_col).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
