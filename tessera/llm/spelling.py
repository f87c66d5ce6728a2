"""Spelling variants: words that differ by one letter, found over an index of variable-length grams.

Words are counted over whole texts. A dictionary of grams is pruned by frequency: a gram is kept when all its shorter
beginnings are frequent, so that common strings of letters get long grams and rare ones short. Each word is decomposed
into the longest grams that the dictionary has at each place. At most ``affected`` of a word's grams change with one edit,
so two near words share all but so many; lists of pairs of grams with their places are merged, and every pair of words that
meets in a list is verified.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import give_back, mix64, small_batches, string_hashes, text_blocks, written

#: Least letters of a word, least occurrences, and how much more frequent a form must be.
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a letter, as its hash decides.
MISSPELT = 97
#: Shortest gram, and the longest one in words of at least so many letters.
SHORTEST, LONGEST = 2, ((5, 3), (9, 4), (12, 5))
#: A gram is frequent when it makes more than this share of all grams of its length: at most 10,000 of a length are.
FREQUENT = 10_000
#: Different words that a task holds before it hands their counts on.
HELD = 200_000
#: Longest words that the built-in edit distance compares.
QUADRATIC = 64

_START, _END = "\x02", "\x03"


def longest(letters: int) -> int:
    """The longest gram in words of so many letters that are the shorter ones of their pairs, or of equal length."""
    return max(q for least, q in LONGEST if letters >= least)


# Words and their counts


def _letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Flags of the bytes that belong to A-Z, a-z or U+00C0 to U+00FF (0xC3 and the byte after it) in UTF-8."""
    wide = raw == 0xC3
    after = np.append(False, wide[:-1])[: len(raw)]
    low = raw | 0x20
    return ((low >= 97) & (low <= 122) & (raw < 128)) | wide | after


@lru_cache(maxsize=4096)
def _shifts(length: int) -> np.ndarray:
    """Four tables of 256: what ``length`` zero bytes make of each byte of a crc32."""
    zero = bytes(length)
    base = crc32(zero, 0)
    return np.array([[crc32(zero, i << (8 * k)) ^ base for i in range(256)] for k in range(4)], np.uint32)


def crc32_of_joined(before: np.ndarray, after: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the strings that end in ``after`` (crc32 and size in bytes of the ends, crc32 of what stands before)."""
    out = after.astype(np.uint32)
    for size in np.unique(sizes).tolist():
        at = (sizes == size).nonzero()[0]
        if size > 4096:  # tables cost more than they save
            zero = bytes(size)
            base = crc32(zero, 0)
            out[at] ^= np.array([crc32(zero, int(x)) ^ base for x in before[at]], np.uint32)
            continue
        t, x = _shifts(size), before[at]
        out[at] ^= t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return out


def _counts_of(raw: np.ndarray, bounds: np.ndarray, before: np.ndarray, least: int, total: Counter) -> None:
    """Adds the words of some texts to ``total``; ``before``: crc32 of each text's id and a colon."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    letters = _letter_bytes(low)
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    left, right = np.append(False, letters), np.append(letters, False)
    start = (right[:-1] & (~left[:-1] | cut[:-1])).nonzero()[0]
    end = (left[1:] & (~right[1:] | cut[1:])).nonzero()[0] + 1
    wide = np.append(0, np.cumsum(low == 0xC3))
    keep = end - start - (wide[end] - wide[start]) >= least
    start, end = start[keep], end[keep]
    if not len(start):
        return
    of = np.searchsorted(bounds, start, "right") - 1
    words, first, which, n = np.unique(string_hashes(low, start, end), return_index=True, return_inverse=True, return_counts=True)
    strings = [low[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    own = np.array([crc32(s) for s in strings], np.uint32)
    # One hash per text and word; a word's occurrences in one text share it.
    pair, times = np.unique(of.astype(np.int64) * len(words) + which, return_counts=True)
    doc, word = pair // len(words), pair % len(words)
    sizes = (end - start)[first]
    hashed = crc32_of_joined(before[doc], own[word], sizes[word])
    struck = (hashed % MISSPELT == 0).nonzero()[0]
    n = n - np.bincount(word[struck], weights=times[struck], minlength=len(words)).astype(np.int64)
    for s, k in zip(strings, n.tolist(), strict=True):
        if k:
            total[s] += k
    for w, h, k in zip(word[struck].tolist(), hashed[struck].tolist(), times[struck].tolist(), strict=True):
        s = strings[w].decode()
        at = h % len(s)
        if len(s) > least:
            total[(s[:at] + s[at + 1 :]).encode()] += k


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts that have enough letters and stand often enough.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. One run in ``MISSPELT`` loses a letter:
    those whose crc32 of "id:run" the number divides, at the place that the crc32 gives. Null texts have no words; a null id
    counts as the empty string; a run across two texts is two; repeated rows count each time.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        total: Counter = Counter()

        def handed_on():
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()

        for batch in batches:
            ids = [crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()]
            for a, b, raw, bounds in text_blocks(batch.column(1)):
                _counts_of(raw, bounds, np.array(ids[a:b], np.uint32), min_letters, total)
                if len(total) > HELD:
                    yield from handed_on()
        yield from handed_on()
        give_back()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# The dictionary of grams and the decomposition


def _by_length(column, step: int = 1 << 20):
    """(letters, Arrow array of words of so many, their letters between the bounds) of a column of words, some at a time."""
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    for letters in np.unique(sizes).tolist():
        own = column.take(pa.array((sizes == letters).nonzero()[0]))
        few = max(1, step // max(1, letters))
        for a in range(0, len(own), few):
            part = own.slice(a, few)
            text = "".join(f"{_START}{w}{_END}" for w in part.to_pylist())
            yield letters, part, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, letters + 2)


def frequent_grams(words: DataFrame, word_col: str = "word") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the codes of the frequent grams of all words between their bounds, sorted, and how often each stands:
    ``FREQUENT`` of a length at most."""
    lengths = range(SHORTEST, max(q for _, q in LONGEST) + 1)

    def run(batches):
        for batch in batches:
            for _, _, chars in _by_length(batch.column(0)):
                for q in lengths:
                    codes, n = np.unique(gram_codes(chars, q), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), q, np.int32)), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["q", "code", "n"])

    counts = words.select(word_col).mapInArrow(run, "q int, code long, n long").groupBy("q", "code").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    total = {r.q: r.n for r in counts.groupBy("q").agg(F.sum("n").alias("n")).collect()}  # one row per length
    found: dict[int, list[tuple[int, int]]] = {q: [] for q in lengths}
    if total:
        enough = F.create_map(*[F.lit(x) for q, n in total.items() for x in (q, n)])
        for r in counts.where(F.col("n") * FREQUENT > F.element_at(enough, F.col("q"))).collect():  # fewer than FREQUENT of each length
            found[r.q].append((r.code, r.n))
    return {q: (np.array([c for c, _ in sorted(x)], np.uint64), np.array([n for _, n in sorted(x)], np.int64)) for q, x in found.items()}


def gram_codes(chars: np.ndarray, q: int) -> np.ndarray:
    """The gram of q letters at each place of words of one length: eight bits a letter, all of them below U+0100."""
    n = max(0, chars.shape[1] - q + 1)
    out = np.zeros((len(chars), n), np.uint64)
    for i in range(q if n else 0):
        out = (out << np.uint64(8)) | chars[:, i : i + n]
    return out


class GramIndex:
    """The pruned dictionary, and the keys under which a word is listed."""

    def __init__(self, frequent: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.frequent = frequent

    def _count(self, codes: np.ndarray, q: int) -> np.ndarray:
        """How often each frequent gram stands, 0 for the others."""
        known, counts = self.frequent[q]
        if not len(known):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, counts[at], 0)

    def grams(self, chars: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length between their bounds, by place: (size, code, count, listed) of the longest gram that the
        dictionary has there, at most q letters; listed ones don't lie inside one that begins before."""
        m = chars.shape[1]
        code = gram_codes(chars, SHORTEST)
        size = np.full(code.shape, SHORTEST)
        count = self._count(code, SHORTEST)
        for k in range(SHORTEST + 1, q + 1):
            longer = gram_codes(chars, k)
            grows = np.zeros(code.shape, bool)
            grows[:, : longer.shape[1]] = ((size == k - 1) & (count > 0))[:, : longer.shape[1]]
            code[grows] = longer[grows[:, : longer.shape[1]]]
            size[grows] = k
            count[grows] = self._count(code[grows], k)
        end = np.arange(m - 1) + size
        before = np.maximum.accumulate(end, 1)
        listed = np.concatenate([np.ones((len(chars), 1), bool), end[:, 1:] > before[:, :-1]], 1)
        return size, code | (size.astype(np.uint64) << np.uint64(56)), count, listed

    @staticmethod
    def affected(size: np.ndarray, listed: np.ndarray, q: int) -> np.ndarray:
        """Per word the most listed grams that one edit can change.

        A gram's size hangs on its own letters alone, for it ends with the first beginning that is not frequent. So an edit
        of the letter at i changes grams that hold it, and grams after it that a new gram can swallow: one that
        begins at i or before, has q letters at most and reaches as far. Inserted letters count as an edit between two places.
        """
        n, places = size.shape  # places + 1 marks stand in a word; the first and last are its bounds
        pad = lambda x: np.pad(x, ((0, 0), (q, q)))
        size, listed = pad(size), pad(listed)
        replaced, inserted = np.zeros((n, places), np.int16), np.zeros((n, places), np.int16)  # of the edits at 1, ..., places
        for d in range(1 - q, q):  # from the edit to the gram
            s, here = size[:, q + 1 + d : q + 1 + d + places], listed[:, q + 1 + d : q + 1 + d + places]
            replaced += here & ((s > -d) if d <= 0 else (d <= q - s))
            inserted += here & ((s > -d) if d < 0 else (d <= q - s - 1))
        return np.maximum(replaced[:, :-1].max(1), inserted.max(1)).astype(np.int64)

    def keys(self, chars: np.ndarray, q: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the lists that words of one length stand in; with ``probe``, of those in which words with one more
        letter stand that may be near.

        A word of N listed grams shares T = N - affected of them with each near word. Of these, in an order by frequency and
        place, the first two are among the first affected + 2 grams of either word: a list for each two of them. Two words
        of T = 1 share one gram: a list for each gram of such words besides. Words of equal length share grams at equal places;
        in a word with one more letter, those after the edit stand one place later.
        """
        size, code, count, listed = self.grams(chars, q)
        n, places = size.shape
        most = self.affected(size, listed, q)
        shared = listed.sum(1) - most
        if n and shared.min() < 1:
            raise ValueError(f"words of {chars.shape[1] - 2} letters have no gram that is sure to stay")
        # Rare grams first; of equally frequent ones the code, then the place decides.
        rank = np.lexsort((np.broadcast_to(np.arange(places), code.shape), mix64(code, 5), count, ~listed), axis=1)
        width = int(min(places, (most + 2).max())) if n else 0
        rank = rank[:, :width]
        used = (np.arange(width) < (most + 2)[:, None]) & np.take_along_axis(listed, rank, 1)
        place = np.where(used, rank, places)
        place.sort(1)
        used, place = place < places, np.minimum(place, places - 1)
        gram = np.take_along_axis(code, place, 1)
        base = np.uint64(chars.shape[1] + int(probe)) * np.uint64(8) + np.uint64(q)
        token = lambda g, p: mix64(mix64(g, 11) + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 13)
        at = [token(gram, place + d) for d in (0, 1)]
        rows, found = [], []
        for a in range(width):
            for b in range(a + 1, width):
                row = (used[:, a] & used[:, b]).nonzero()[0]
                for i, j in ((0, 0), (0, 1), (1, 1))[: 3 if probe else 1]:
                    rows.append(row)
                    found.append(mix64(at[i][row, a] + mix64(at[j][row, b] + base, 17), 19))
        alone = (shared == 1).nonzero()[0]
        if len(alone):
            row, p = listed[alone].nonzero()
            for d in (0, 1)[: 2 if probe else 1]:
                rows.append(alone[row])
                found.append(mix64(token(code[alone[row], p], p + d) + base, 23))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _listed(words: DataFrame, index, probing: bool) -> DataFrame:
    """(word, odd, key): every list that a word stands in, or that it asks for near words of its length and one letter more;
    ``odd`` has the bits of the letters that the word holds an odd number of times, of which one edit changes two at most."""

    def run(batches):
        grams: GramIndex = index.value
        for batch in batches:
            for letters, part, chars in _by_length(batch.column(0)):
                odd = np.bitwise_xor.reduce(np.uint64(1) << (chars[:, 1:-1] & np.uint64(63)), axis=1).view(np.int64)
                if probing:
                    asked = [(longest(letters), False), (longest(letters), True)]
                else:  # for words of its length, and for shorter ones that ask by another dictionary
                    asked = [(q, False) for q in sorted({longest(letters), longest(max(MIN_LETTERS, letters - 1))})]
                for q, probe in asked:
                    row, key = grams.keys(chars, q, probe)
                    for b in range(0, len(row), 1 << 18):
                        some = row[b : b + (1 << 18)]
                        yield pa.RecordBatch.from_arrays([part.take(pa.array(some)), pa.array(odd[some]), pa.array(key[b : b + (1 << 18)].view(np.int64))], names=["word", "odd", "key"])
        give_back()

    return words.select("word").mapInArrow(run, "word string, odd long, key long")


def one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced letter makes ``b`` of the word ``a``, which is no longer than it and differs.

    The built-in distance takes time as the square of very long words: there, what follows the first difference is compared.
    """
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    at = F.coalesce(F.nullif(F.array_position(letters, False), F.lit(0)), F.length(a) + 1).cast("int")
    rest = F.substring(a, at + F.when(F.length(a) == F.length(b), 1).otherwise(0), F.length(a))
    linear = (F.length(b) - F.length(a) <= 1) & (F.substring(b, at + 1, F.length(b)) == rest)
    return F.when(F.length(b) <= QUADRATIC, F.levenshtein(a, b, 1) == 1).otherwise(linear)


def near_words(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, near): all pairs of different words of ``MIN_LETTERS`` letters or more that one inserted, deleted or
    replaced letter parts, in both directions. Letters are those below U+0100. Null words are near to none."""
    words = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull())
    index = words.sparkSession.sparkContext.broadcast(GramIndex(frequent_grams(words)))  # FREQUENT grams of each length at most
    asking = _listed(words, index, True)
    standing = _listed(words, index, False).withColumnsRenamed({"word": "near", "odd": "odd_near"})
    may_be = F.bit_count(F.col("odd").bitwiseXOR(F.col("odd_near"))) <= 2
    different = (F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))
    # Spark takes the lists for as large as the words that they are made of, and would broadcast them.
    pairs = asking.join(standing.hint("merge"), "key").where(may_be & different & one_edit(F.col("word"), F.col("near"))).select("word", "near").distinct()
    pairs = written(pairs, "near-words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


# Forms


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each step doubles the way, so that few are needed; ``n`` at least doubles with each form."""
    way = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = way.select(F.col("word").alias("root"), F.col("root").alias("up"))
        longer = way.join(step.hint("merge"), "root", "left")
        if longer.where(F.col("up").isNotNull()).isEmpty():
            return way
        way = written(longer.select("word", F.coalesce("up", "root").alias("root")), "forms")


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each (word, n): its form is the near word of largest n, of equal ones the
    smallest by code point, if that n is at least ``ratio`` times the word's own; its root is where the forms lead.

    Words without a near one have n_near 0 and are their own root. Words that come twice count once, with their largest n.
    No table of words is broadcast: in memory it is many times its files.
    """
    counts = written(counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("n").alias("n")), "words")
    near = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("m")).hint("merge"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), F.col("near").alias("form"))).alias("best"))
    judged = counts.join(best.hint("merge"), "word", "left").withColumn("good", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False)))
    kept = lambda c: F.when(F.col("good"), c)
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), kept(F.col("best.form")).alias("form"), kept(-F.col("best.order")).alias("form_n"))
    judged = written(judged, "judged")
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with their forms and roots, as ``word_counts`` and ``group_variants`` state it."""
    return group_variants(word_counts(docs, id_col, text_col))
