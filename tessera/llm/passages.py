"""Verbatim passages of ``PASSAGE`` words or more that stand in several places, wherever lines begin or end.

Each window of ``PASSAGE`` words has the run of ``GRAM`` words of least hash in it as its anchor, so equal windows
have equal anchors. Neighbouring windows with one anchor form a stretch. Inside a copied passage stretches are
copied whole and one of equal ones stands for all; only the windows of different stretches that share an
anchor, those at a passage's ends, are compared one by one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import ascii_words, map_texts, word_hashes, written
from tessera.llm.suffix_dedup import Hasher, _slide

PASSAGE, GRAM = 50, 25
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")

STRETCHES = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("anchor", T.LongType()), T.StructField("whole", T.LongType()),
]))
SPANS = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("words", T.LongType())]))


def stretches(words: np.ndarray, first: np.ndarray, hasher: Hasher):
    """Per text an Arrow list of its runs of ``n`` windows from word ``start`` on with one anchor; ``whole`` names all
    their words. Text i has the words first[i]..first[i + 1] - 1."""
    import pyarrow as pa

    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = (np.arange(len(words)) + PASSAGE <= first[1:][text]).nonzero()[0]
    begin, n, anchor, whole = (np.zeros(0, np.int64) for _ in range(4))
    if len(starts):
        h = hasher(words, GRAM)
        width = PASSAGE - GRAM + 1
        low = _slide(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        places = (h == _slide(np.concatenate([pad, low, pad]), width, np.maximum)).nonzero()[0]
        low = low[starts]
        nearest = np.searchsorted(places, starts)
        while len(off := (h[places[nearest]] != low).nonzero()[0]):
            nearest[off] += 1
        new = np.append(True, (nearest[1:] != nearest[:-1]) | (np.diff(starts) != 1)).nonzero()[0]
        begin, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        n, anchor = last - begin + 1, h[places[nearest[new]]].view(np.int64)
        # Two windows that overlap or meet and their distance tell what a stretch holds: it is never longer than two of them.
        w = hasher(words, PASSAGE)
        odd = np.uint64(0x9E3779B97F4A7C15)
        whole = ((w[begin] * odd ^ w[last]) * odd ^ n.astype(np.uint64)).view(np.int64)
    at = text[begin] if len(begin) else begin
    columns = [pa.array((begin - first[at]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(whole)]
    rows = pa.StructArray.from_arrays(columns, names=STRETCHES.elementType.names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(first))).astype(np.int32)), rows)


def _windows(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(whole, at, window) of each window of the stretches ``reps`` (text_key, start, n, whole), read again from the texts."""
    by_text = reps.groupBy("text_key").agg(F.collect_set(F.struct("whole", "start", "n")).alias("reps"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(by_text, "text_key")
    one = T.StructType([T.StructField("whole", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))])
    packed = texts.select(F.struct("text", F.to_json("reps").alias("reps")).alias("t"))

    def make():
        import json

        hasher = Hasher()

        def work(rows):
            out = []
            for r in rows:
                w = hasher(word_hashes(ascii_words(r["text"])), PASSAGE).view(np.int64)
                out.append([{"whole": p["whole"], "windows": w[p["start"] : p["start"] + p["n"]]} for p in json.loads(r["reps"])])
            return [out]

        return work

    found = map_texts(packed, "t", [], [T.StructField("found", T.ArrayType(one))], make)
    found = found.select(F.explode("found").alias("f")).select("f.*").dropDuplicates(["whole"])
    return found.select("whole", F.posexplode("windows").alias("at", "window"))


def _gone(first: Column, doc: Column, text_key: Column, start: Column) -> Column:
    """Whether the place goes: its first place is another one that stays and that it does not overlap."""
    same = first["doc"].eqNullSafe(doc) & (first["text_key"] == text_key)
    return (first["lost"] == 0) & ~(same & (F.abs(start - first["start"]) < PASSAGE))


def passage_hits(each: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text_key, start, n, gone) of runs of n windows that stand in another place too.

    ``each`` has the stretches of all texts: (doc, text_key, lost, start, n, anchor, whole); ``lost`` is 1 where
    some of its words leave with their line, and such a place is nobody's first one.
    """
    shared = written(each.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "stretch-anchors")
    placed = written(each.join(shared, "anchor", "left_semi"), "stretches")
    wholes = placed.groupBy("whole").agg(
        F.min(F.struct("lost", "doc", "text_key", "start")).alias("first"), F.count("*").alias("copies"), F.min("anchor").alias("anchor"), F.min("n").alias("n")
    )
    wholes = written(wholes, "stretch-firsts")
    copied = placed.join(wholes.where("copies > 1").select("whole", "first"), "whole")
    copied = copied.select("doc", "text_key", "start", "n", _gone(F.col("first"), F.col("doc"), F.col("text_key"), F.col("start")).alias("gone"))
    mixed = written(wholes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "mixed-anchors")
    reps = written(wholes.join(mixed, "anchor", "left_semi").select("whole", "first", "n"), "stretch-ends")
    windows = _windows(reps.select("first.text_key", "first.start", "n", "whole"), docs).join(reps.select("whole", "first"), "whole")
    windows = windows.select("window", F.col("first.lost").alias("lost"), F.col("first.doc").alias("doc"), F.col("first.text_key").alias("text_key"), (F.col("first.start") + F.col("at")).alias("start"))
    windows = written(windows, "windows")
    firsts = windows.groupBy("window").agg(F.min(F.struct("lost", "doc", "text_key", "start")).alias("first"), F.count("*").alias("k")).where("k > 1").select("window", "first")
    ends = windows.join(firsts, "window").select("doc", "text_key", "start", F.lit(1).alias("n"), _gone(F.col("first"), F.col("doc"), F.col("text_key"), F.col("start")).alias("gone"))
    return copied.union(ends)


def _merged(row: np.ndarray, word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the runs that each row's runs cover, those that meet as one."""
    step = np.int64(1) << np.int64(40)
    begin, end = row * step + word, row * step + word + words
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)].nonzero()[0]
    last = end[np.append(new[1:], len(end)) - 1] if len(new) else end
    return begin[new] // step, begin[new] % step, last - begin[new]


def merged(by_text: DataFrame) -> DataFrame:
    """``by_text`` with, for its hits (word, words, gone), ``runs``: how many runs of a text's words stand elsewhere too,
    and ``spans``: those that go. ``gone`` is null where a paragraph decides."""
    import pyarrow as pa

    kept = [c for c in by_text.columns if c != "hits"]
    schema = T.StructType([*(by_text.schema[c] for c in kept), T.StructField("runs", T.LongType()), T.StructField("spans", SPANS)])

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            hits = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            word, words = (hits.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word", "words"))
            gone = hits.field("gone").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            runs = np.bincount(_merged(row, word, words)[0], minlength=len(lists))
            of, begin, size = _merged(row[gone], word[gone], words[gone])
            spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(size, pa.int64())], names=["word", "words"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(runs, pa.int64()), lists], names=schema.names)

    return by_text.select(*kept, "hits").mapInArrow(run, schema)


def cut(text, lines, spans):
    """``text`` without the lines and runs of words; a line that loses all its words goes too."""
    if text is None:
        return None
    drop, runs = set(lines or []), [(s["word"], s["word"] + s["words"]) for s in spans or []]
    out, at, r = [], 0, 0
    for pos, line in enumerate(text.split("\n")):
        found = list(_WORD.finditer(line))
        left, kept, end = [], 0, 0
        for i, m in enumerate(found):
            while r < len(runs) and runs[r][1] <= at + i:
                r += 1
            stop = found[i + 1].start() if i + 1 < len(found) else len(line)
            if r == len(runs) or at + i < runs[r][0]:
                left.append(line[end if i == 0 else m.start() : stop])
                kept += 1
        at += len(found)
        if pos not in drop and (kept or not found):
            out.append("".join(left) if found else line)
    return "\n".join(out)
