"""Benchmark items inside documents, edited ones too: CGK embedding, bit-sampling LSH, exact edit distance.

An item and a passage match when the edit distance of their word sequences is at most ``SHARE`` of the
item's words; one of fewer than five words must stand unchanged. A random walk embeds a word sequence so that few
edits give few differing symbols; samples of an embedding's symbols are its keys, in as many repetitions as the target
recall needs at the item's length, and windows as long as an item that share a key with it are compared exactly.

Windows that cannot match are left out before they are embedded, without loss: of an item cut into one
piece more than the edits it may have, some piece stands unchanged in every match.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import free_names, map_blocks, mix64, string_hashes, text_blocks, words_of

#: Edits that a match may have, as a share of the item's words.
SHARE = 0.2
#: Symbols in a key; the recall that the repetitions are set for, at the largest distance.
SAMPLED, RECALL = 3, 0.99
#: Longer items are looked for by parts of so many words at most and compared whole.
PART_WORDS = 400
#: Words of the items that are broadcast at once; a longer benchmark takes several passes.
BLOCK_WORDS = 1 << 20
#: ASCII punctuation and control characters part words, and scripts without spaces give one of each character.
PARTS = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])"


def plain(column):
    """An Arrow column of texts in lower case, characters of scripts without spaces set apart."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    data = column.buffers()[2]
    if data is not None and (np.frombuffer(data, np.uint8) >= 0xE0).any():
        column = pc.replace_substring_regex(column, ALONE, r" \1 ")
    return column


def text_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation of ``plain`` texts, and each text's first one."""
    start, end, first = words_of(raw, bounds, PARTS)
    return string_hashes(raw, start, end), first


def words(text: str | None) -> np.ndarray:
    """Hashes of one text's words."""
    import pyarrow as pa

    return np.concatenate([text_words(raw, bounds)[0] for _, _, raw, bounds in text_blocks(plain(pa.array([text], pa.string())))])


def grams(hashes: np.ndarray, q: int) -> np.ndarray:
    out = hashes[: max(0, len(hashes) - q + 1)]
    for i in range(1, q):
        out = mix64(out, q) + hashes[i : len(hashes) - q + 1 + i]
    return mix64(out, 100 + q)


def steps(length: int) -> int:
    """Steps of a walk over ``length`` symbols that hardly ever lead past its end: it moves on at half of them."""
    return max(length, int(2 * length - 3 * np.sqrt(2 * length)))


def walks(length: int) -> int:
    """Walks that the repetitions take turns in: more of short ones, which have few places to sample."""
    return max(8, min(64, 320 // length))


def embed(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of each row: the walk copies the symbol it stands on and moves on by a random bit of the step and
    that symbol; 0 after the end."""
    width = rows.shape[1]
    padded = np.concatenate([rows, np.zeros((len(rows), 1), np.uint64)], 1)
    at, out, index = np.zeros(len(rows), np.int64), np.empty((len(rows), steps(width)), np.uint64), np.arange(len(rows))
    for step in range(steps(width)):
        symbol = padded[index, at]
        out[:, step] = symbol
        at = np.minimum(at + (mix64(symbol, seed * 1_000_003 + step) & np.uint64(1)).astype(np.int64), width)
    return out


def sampled_keys(embedded: np.ndarray, length: int, repetition: int, sampled: int = SAMPLED) -> np.ndarray:
    """One key per row, of ``sampled`` symbols at places drawn for the length and repetition."""
    places = np.random.default_rng((length, repetition)).choice(steps(length), min(sampled, steps(length)), replace=False)
    key = np.full(len(embedded), length, np.uint64)
    for p in places:
        key = mix64(key ^ embedded[:, p], repetition)
    return key


def edited(word: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """``word`` after random edits: a symbol replaced, left out or doubled by a new one."""
    word = list(word)
    for _ in range(edits):
        at, kind, new = int(rng.integers(len(word))), int(rng.integers(3)), int(rng.integers(1, 2**63))
        word[at : at + 1] = [[new], [], [word[at], new]][kind] if len(word) > 1 else word
    return word


@lru_cache(maxsize=256)
def _repetitions(length: int, share: float, recall: float, sampled: int) -> int:
    rng = np.random.default_rng(7)
    edits, trials = int(share * length), 400
    q = length // (edits + 1)
    items, windows, of = [], [], []
    for i in range(trials):
        item = rng.integers(1, 2**63, length).astype(np.uint64)
        text = np.array([*rng.integers(1, 2**63, 2 * length).tolist(), *edited(item.tolist(), edits, rng), *rng.integers(1, 2**63, 2 * length).tolist()], np.uint64)
        place = {g: p for p, g in enumerate(grams(text, q).tolist())}
        starts = {place[g] - o * q for o, g in enumerate(grams(item, q)[: (edits + 1) * q : q].tolist()) if g in place}
        items.append(item)
        windows += [text[s : s + length] for s in starts]
        of += [i] * len(starts)
    turn, of, most = walks(length), np.array(of, np.int64), 64
    while True:  # one walk is held at a time
        first = np.full(trials, most)
        for walk in range(turn):
            before, after = embed(np.array(items), walk), embed(np.array(windows), walk)
            for r in range(walk, most, turn):
                a, b = (sampled_keys(x, length, r, sampled) for x in (before, after))
                np.minimum.at(first, of[a[of] == b], r)
        enough = np.sort(first)[int(np.ceil(recall * trials)) - 1]
        if enough < most:
            return int(enough) + 1
        most *= 4


def repetitions(length: int, share: float = SHARE, recall: float = RECALL, sampled: int = SAMPLED) -> int:
    """Repetitions that reach ``recall`` for items of ``length`` words, measured on random sequences with the largest
    allowed distance, at the next of a row of lengths that grow by a fifth; windows lie where an unchanged piece puts them.
    Items are searched by parts of ``PART_WORDS`` words at most, for which some hundreds are enough."""
    if int(share * length) == 0:
        return 1
    classes = [5]
    while classes[-1] < length:
        classes.append(-(-classes[-1] * 6 // 5))
    return _repetitions(classes[-1], share, recall, sampled)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` nearest to ``item``; the first such end, then the longest."""
    m = len(text)
    previous, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, symbol in enumerate(item, 1):
        diagonal = previous[:-1] + (text != symbol)
        upper = previous[1:] + 1
        current, start = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        current[0], start[0] = i, 0
        current[1:], start[1:] = np.minimum(diagonal, upper), np.where(diagonal <= upper, begin[:-1], begin[1:])
        # A run of insertions costs one per step: the cheapest source to the left, by value less place.
        slack = current - np.arange(m + 1)
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, np.arange(m + 1), 0))
        previous, begin = low + np.arange(m + 1), start[source]
    end = int(previous.argmin())
    return int(previous[end]), int(begin[end]), end


@dataclass
class Items:
    """Searchable items: their words, the pieces that a match must hold, and their keys.

    An item of more than ``PART_WORDS`` words is cut into equal parts: of a match's edits, one part at least has no more than
    its share. Pieces and keys are those of the parts, and a part that is found names the whole item's place.
    """

    ids: list
    words: list[np.ndarray]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: bit table, hashes, offsets, item sizes
    keys: dict[int, tuple[int, np.ndarray, np.ndarray]]  # by size: repetitions, sorted keys of all of them, their parts
    share: float
    parts: np.ndarray  # rows (item, words before the part)

    @classmethod
    def of(cls, rows: list[tuple], share: float, recall: float) -> Items:
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in rows) if len(w)]
        found: dict[int, set] = defaultdict(set)
        by_size: dict[int, list[int]] = defaultdict(list)
        parts = []
        for j, (_, whole) in enumerate(kept):
            cuts = np.linspace(0, len(whole), -(-len(whole) // PART_WORDS) + 1).astype(int).tolist()
            parts += [(j, a, whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for j, (_, _, w) in enumerate(parts):
            by_size[len(w)].append(j)
            n = int(share * len(w)) + 1
            q = len(w) // n
            for o, g in enumerate(grams(w, q)[: n * q : q].tolist()):
                found[q].add((g, o * q, len(w)))
        pieces = {}
        for q, entries in found.items():
            table = np.zeros(1 << 20, bool)
            rows_ = sorted(entries)
            g = np.array([e[0] for e in rows_], np.uint64)
            table[g >> np.uint64(44)] = True
            pieces[q] = table, g, np.array([e[1] for e in rows_]), np.array([e[2] for e in rows_])
        keys = {}
        for size, members in by_size.items():
            times, turn, all_keys = repetitions(size, share, recall), walks(size), []
            rows_ = np.array([parts[j][2] for j in members])
            for walk in range(min(turn, times)):
                embedded = embed(rows_, walk)
                all_keys += [sampled_keys(embedded, size, r) for r in range(walk, times, turn)]
            all_keys = np.concatenate(all_keys)
            order = np.argsort(all_keys, kind="stable")
            keys[size] = times, all_keys[order], np.tile(members, times)[order]
        return cls([i for i, _ in kept], [w for _, w in kept], pieces, keys, share, np.array([p[:2] for p in parts], np.int64).reshape(-1, 2))

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct rows (size, text, start) of item-sized windows that hold an item's piece at its place."""
        out = [np.zeros((0, 3), np.int64)]
        for q, (table, known, offsets, sizes) in self.pieces.items():
            g = grams(hashes, q)
            at = table[g >> np.uint64(44)].nonzero()[0]
            text = np.searchsorted(first, at, "right") - 1
            at, text = at[inside := at + q <= first[text + 1]], text[inside]
            low, high = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
            n = high - low
            entry = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            text = np.repeat(text, n)
            out.append(np.stack([sizes[entry], text, np.repeat(at, n) - first[text] - offsets[entry]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, start) of windows that share a key with the item or a part of it; start is the whole item's."""
        out = [np.zeros((0, 3), np.int64)]
        windows = self.windows(hashes, first)
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            for size in np.unique(part[:, 0]).tolist():
                text, start = part[part[:, 0] == size, 1:].T
                place = (first[text] + start)[:, None] + np.arange(size)
                within = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
                rows = np.where(within, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))
                times, known, found = self.keys[size]
                for walk in range(min(turn := walks(size), times)):
                    embedded = embed(rows, walk)
                    for r in range(walk, times, turn):
                        key = sampled_keys(embedded, size, r)
                        low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                        n = high - low
                        if n.any():
                            entry = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
                            item, before = self.parts[found[entry]].T
                            out.append(np.stack([np.repeat(text, n), item, np.repeat(start, n) - before], 1))
        return np.unique(np.concatenate(out), axis=0)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple]]:
        """Per text (item id, start, end, distance), in words; an item's matches never overlap."""
        found: list[list[tuple]] = [[] for _ in range(len(first) - 1)]
        for d, j, start in self.candidates(hashes, first).tolist():
            item = self.words[j]
            most = int(self.share * len(item))
            low, high = max(0, start - 2 * most), start + len(item) + 2 * most
            if any(i == j and s - most <= start < e for i, s, e, _ in found[d][-8:]):
                continue
            distance, a, b = best_match(item, hashes[first[d] : first[d + 1]][low:high])
            if distance <= most and not any(i == j and s < low + b and low + a < e for i, s, e, _ in found[d]):
                found[d].append((j, low + a, low + b, distance))
        return [[(self.ids[j], s, e, k) for j, s, e, k in sorted(f)] for f in found]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """The ``keep`` columns and ``leaks``: (item, start, end, distance) per match, in words of the document.

    The benchmark is worked on in blocks of about ``BLOCK_WORDS`` words, each broadcast in turn against all
    documents. Null texts and ids of items are left out, equal items are each found; null and empty documents
    have no leaks; a column called leaks is replaced, others pass.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    kind = T.ArrayType(T.StructType([
        T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("distance", T.LongType()),
    ]))
    keep = [c for c in keep if c != "leaks"]
    out = docs.select(*keep, *[text_col] * (text_col not in keep))
    names = free_names(out.columns, *[f"leaks_{i}" for i in range(blocks)]) if blocks > 1 else ["leaks"]
    for block, name in enumerate(names):
        rows = [(r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows, share, recall))

        def make(shared=shared):
            def work(raw, bounds):
                found = shared.value.search(*text_words(raw, bounds))
                return None, [[[dict(zip(("item", "start", "end", "distance"), m, strict=True)) for m in f] for f in found]]

            return work

        last = block == blocks - 1
        out = map_blocks(out, text_col, [c for c in out.columns if c != text_col or c in keep or not last], [T.StructField(name, kind)], make, plain)
    if blocks > 1:
        out = out.select(*keep, F.concat(*names).alias("leaks"))
    return out


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, item_id, n_matches, distance): each document's leaked items, with the smallest distance."""
    found = find_leaks(docs, benchmark, [id_col])
    item = benchmark.schema["item_id"].dataType
    return found.select(id_col, F.explode("leaks").alias("m")).groupBy(id_col, F.col("m.item").cast(item).alias("item_id")).agg(F.count("*").alias("n_matches"), F.min("m.distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    return find_leaks(docs, benchmark, docs.columns, text_col).where(F.size("leaks") == 0).drop("leaks")
