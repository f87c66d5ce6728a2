"""Token sequences of fixed length: documents cut into pieces, pieces packed by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import SPACES, free_names, map_blocks, string_hashes, written

LENGTH = 1024
END = 2
#: Pieces that one task packs: a task's memory is bounded and what a shard wastes (a few open bins) is not felt.
SHARD = 20_000
#: Bytes of word ids that a worker keeps from text to text.
KEPT_BYTES = 32 << 20
#: White space beyond ASCII, as UTF-8; a word of Latin letters.
_WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_PLAIN = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LETTER, _MARK = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]), np.isin(np.arange(256), [44, 46])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of whole texts by the ``tokenizers`` file at ``path``, special tokens not added.

    The byte-level pre-tokenizer takes of several white-space characters in a row the last one apart, begins a
    token at it, and parts a mark from the letter before it, so a text's ids are those of its words, gaps and last
    marks one after another. Each distinct one, told by a 64-bit hash, is encoded once and kept, by all tasks of
    a worker. Texts with special tokens or other white space than that of ASCII are encoded whole.
    """

    _workers: dict[str, Ids] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join([_WIDE, *added]))
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = dict(zip(shown, shown, strict=True)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self._forget()

    @classmethod
    def of_worker(cls, path: str) -> Ids:
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def _forget(self) -> None:
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each word, gap or last mark, each text's first one)."""
        blank = SPACES[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        first, last = edge[:-1], edge[1:]
        before, after = np.append(False, blank[:-1]) & ~first, np.append(blank[1:], False) & ~last
        tail = blank & ~after & ~last  # a gap's last character, before a word
        start = first | blank & ~before | tail
        start[1:] |= (tail & (raw != 32))[:-1]
        start[1:] |= _LETTER[raw[:-1]] & _MARK[raw[1:]] & (after | last)[1:]
        at = start.nonzero()[0]
        return at, np.searchsorted(at, bounds)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds the words, whose hashes come sorted."""
        sizes, ids, others = np.zeros(len(words), np.int64), [], []
        for i, word in enumerate(words):
            if _PLAIN.fullmatch(word.decode("utf-8", "replace")):  # one token of the pre-tokenizer
                made = [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.alphabet))]
                sizes[i] = len(made)
                ids += made
            else:
                others.append(i)
        if others:
            made = self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in others], add_special_tokens=False)
            sizes[others] = [len(e.ids) for e in made]
            ids += [x for e in made for x in e.ids]
        order = np.append(np.setdiff1d(np.arange(len(words)), others), others).astype(np.int64)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.append(0, np.cumsum(sizes[order]))[:-1] + len(self.ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, np.array(ids, "<u4")])

    def __call__(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's bounds in them)."""
        start, first = self.words(raw, bounds)
        hashes, index, of = np.unique(string_hashes(raw, start, np.append(start[1:], len(raw))[: len(start)]), return_index=True, return_inverse=True)
        if self.ids.nbytes + 24 * len(self.hashes) > KEPT_BYTES:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = (self.hashes[at] != hashes).nonzero()[0] if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            ends = np.append(start[1:], len(raw))
            self._learn(hashes[new], [raw[start[i] : ends[i]].tobytes() for i in index[new].tolist()])
        place = np.searchsorted(self.hashes, hashes)[of]
        size = self.sizes[place]
        to = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(self.starts[place] - to[:-1], size) + np.arange(to[-1])]
        found = to[first]
        odd = sorted({int(np.searchsorted(bounds, m.start(), "right")) - 1 for m in self.whole.finditer(raw.tobytes())})
        if odd:
            parts = np.split(ids, found[1:-1])
            made = self.tokenizer.encode_batch_fast([raw[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace") for i in odd], add_special_tokens=False)
            for i, encoding in zip(odd, made, strict=True):
                parts[i] = np.array(encoding.ids, "<u4")
            ids, found = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, found


def pieces(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """The ``keep`` columns with piece, start, length and ids_crc32 of each piece of each document.

    A document is its ids and ``end``; only one longer than ``length`` is cut, its first piece taking
    what does not fill whole ones. Null text counts as empty: one piece of one id.
    """
    path = path or tokenizer_path()

    def make():
        encode, last = Ids.of_worker(path), np.array([end], "<u4")

        def work(raw, bounds):
            ids, of = encode(raw, bounds)
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                own = np.concatenate([ids[a:b], last])
                cuts = [0, *range(len(own) % length or length, len(own) + 1, length)]
                out += [(i, p, s, e - s, zlib.crc32(own[s:e])) for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            rows, *columns = zip(*out, strict=True)
            return rows, columns

        return work

    fields = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    return map_blocks(docs, text_col, keep, fields, make)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the given order, and the number of bins.

    Each one goes where the sum over residual gaps g in 1..capacity-1 of (open bins of gap g) squared
    becomes smallest, a new bin included; ties go to the smallest gap left. A gap's bin opened last is filled first.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, size in enumerate(map(int, lengths)):
        # Moving a bin from gap g to g - size changes the sum by 2 (count[g - size] - count[g]) + 2; gap 0 is not counted.
        change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
        if size < capacity:
            change[0] = 1 - 2 * count[size]
            change[count[size:capacity] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        best = int(change.argmin()) if size < capacity else 0
        if size < capacity and change[best] <= fresh:
            gap = best + size
            bins[i], offsets[i] = open_bins[gap].pop(), capacity - gap
            count[gap] -= 1
        else:
            gap = capacity
            bins[i], offsets[i] = made, 0
            made += 1
        if gap - size:
            open_bins[gap - size].append(int(bins[i]))
            count[gap - size] += 1
    return bins, offsets, made


def pack(found: DataFrame, keep: list[str], length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset: each sequence holds at most ``length`` ids, without gaps.

    Pieces are dealt to shards of about ``shard`` by their place in the written table, so that many equal ones do
    not meet in one shard; a shard is packed longest piece first.
    """
    found = written(found, "pieces")
    shards = max(1, -(-found.count() // shard))
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    (mine,) = free_names(schema.names, "shard")

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns=mine).sort_values(["length", "piece", "ids_crc32", *keep], ascending=[False, *[True] * (2 + len(keep))], kind="stable")
        bins, offsets, _ = sum_of_squares(group["length"].to_numpy(), length)
        return group.assign(sequence_id=bins * shards + key[0], offset=offsets)

    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    dealt = found.withColumn(mine, F.pmod(place, F.lit(shards)))
    return dealt.groupBy(mine).applyInPandas(one, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each piece's place: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Empty table: no rows. Repeated rows and ids are packed each for itself. Other columns are not read.
    """
    return pack(pieces(docs, [id_col], text_col, path, length), [id_col], length)
