import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination, queries, suffix_dedup


from .conftest import DATA

# ---- suffix dedup


def _brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                if i + length < len(gone):
                    gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _compare(df, rows):
    want = Counter((i, *b) for (i, _), b in zip(rows, _brute([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()) == want


def test_suffix_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    _compare(queries.op9_suffix_dedup(spark, DATA), rows)


@pytest.mark.parametrize(("hot", "block"), [(1000, 2 << 20), (3, 2 << 20), (1, 500)])
def test_suffix_dedup_of_shared_passages(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(hot)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [text(n) for n in (199, 200, 201, 260, 700)]
    rows = [(i, text(rng.randrange(300)) + rng.choice(passages) + text(rng.randrange(50)) + rng.choice(passages)) for i in range(60)]
    rows += [(100, "a" * 1000), (101, "ab" * 400), (102, "a" * 199), (103, "b" * 200), (104, None), (105, ""), (106, "x" * 5000 + text(300))]
    rows += [(107, rows[0][1]), (107, rows[0][1]), (None, passages[4][:250]), (108, passages[4] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _compare(suffix_dedup.digests(docs), rows)


def test_suffix_dedup_works_on_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 333)
    rng = random.Random(5)
    base = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(1, base), (2, base[500:1700] + "zz" + base[100:400]), (3, base[2700:])]
    _compare(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_suffix_dedup_of_odd_rows(odd_documents, no_documents):
    _compare(suffix_dedup.digests(odd_documents), [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert suffix_dedup.digests(no_documents).count() == 0


def test_the_cover_covers():
    c, v = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % v for a in c for b in c} == set(range(v))
    assert max((b - a) % v for a, b in zip(c, [*c[1:], c[0]], strict=True)) <= 8


# ---- decontamination


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=500, deadline=None)
def test_best_match_is_exact(item, text):
    item_, text_ = np.array(item, np.uint64), np.array(text, np.uint64)
    distance, start, end = decontamination.best_match(item_, text_)
    assert distance == _distance(item, text)
    part = text[start:end]
    full = [[i + j if not i * j else 0 for j in range(len(part) + 1)] for i in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(part) + 1):
            full[i][j] = min(full[i - 1][j] + 1, full[i][j - 1] + 1, full[i - 1][j - 1] + (item[i - 1] != part[j - 1]))
    assert full[-1][-1] == distance


def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    want = {}
    for i in items:
        w = decontamination.words(i.text)
        for d in docs:
            distance = decontamination.best_match(w, decontamination.words(d.text))[0]
            if distance <= int(0.2 * len(w)):
                want[d.doc_id, i.item_id] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op5_decontamination(spark, DATA).collect()}
    assert got == want and len(want) > 2


def test_edited_passages_reach_the_recall(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 60)))) for i in range(30)]
    rows, planted = [], set()
    for i in range(300):
        item = rng.choice(items)
        part = item[1].split()
        for _ in range(rng.randrange(int(0.2 * len(part)) + 1)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[word()], [], [part[at], word()]])
        planted.add((i, item[0]))
        rows.append((i, " ".join([*(word() for _ in range(rng.randrange(40))), *part, *(word() for _ in range(40))]).title().replace(" ", " !", 5)))
    rows.append((999, " ".join(word() for _ in range(500))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks_by_document(docs, bench).collect()}
    assert got <= planted and len(got) >= 0.97 * len(planted)


@pytest.mark.parametrize("length", [1, 4, 5, 10, 40, 100, 400, 1000, 2000])
def test_keys_reach_the_recall_and_part_unrelated_windows(length):
    rng = np.random.default_rng(length)
    vocabulary = ["w%x" % i for i in range(20_000)]
    share = 1 / (np.arange(20_000) + 3.7)  # as often as words of a language
    draw = lambda n: [vocabulary[i] for i in rng.choice(20_000, n, p=share / share.sum())]
    texts = [" ".join(draw(length)) for _ in range(20)]
    items = decontamination.Items.of(list(enumerate(texts)), 0.2, decontamination.RECALL)
    trials, texts_of, bounds = 400, [], [0]
    for i in range(trials):
        part = decontamination.edited(decontamination.words(texts[i % 20]).tolist(), int(0.2 * length), rng)
        before, after = (decontamination.words(" ".join(draw(20 + length // 8))) for _ in range(2))
        texts_of.append(np.concatenate([before, np.array(part, np.uint64), after]))
        bounds.append(bounds[-1] + len(texts_of[-1]))
    found = {(t, j) for t, j, _ in items.candidates(np.concatenate(texts_of), np.array(bounds)).tolist()}
    hit = sum((i, i % 20) in found for i in range(trials))
    assert hit >= 0.95 * trials
    if 5 <= length <= decontamination.PART_WORDS:
        times, known, of = items.keys[length]
        rows = np.array([decontamination.words(" ".join(draw(length))) for _ in range(50)])
        walks = [decontamination.embed(rows, walk) for walk in range(decontamination.walks(length))]
        met = np.zeros((50, 20), bool)
        for r in range(times):
            keys = decontamination.sampled_keys(walks[r % len(walks)], length, r)
            for row, key in enumerate(keys):
                met[row, of[np.searchsorted(known, key, "left") : np.searchsorted(known, key, "right")]] = True
        assert met.mean() < 0.1


def test_an_item_of_thousands_of_words(spark):
    import resource

    rng = np.random.default_rng(5)
    word = lambda n: ["w%x" % i for i in rng.integers(0, 5000, n)]
    item, before = word(5000), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    part = list(item)
    for at in rng.choice(5000, 800, replace=False).tolist():
        part[at] = "other"
    docs = spark.createDataFrame([(1, " ".join([*word(300), *part, *word(70)])), (2, " ".join(word(6000))), (3, " ".join(item[:2500]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.leaks_by_document(docs, bench).collect()] == [(1, 1, 800)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB of the driver


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(1, "three word item"), (2, "\u65e5\u672c\u8a9e\u306e\u9577\u3044\u554f\u984c\u6587"), (3, "Alone")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "a Three, word ITEM here"), (2, "three other word item"), (3, "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u9577\u304f\u554f\u984c\u6587\u3067\u3059"), (4, "alone"), (5, "lonely"),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks_by_document(docs, bench).collect()} == {(1, 1), (3, 2), (4, 3)}


def test_columns_called_as_those_of_the_passes_stay(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 4)
    docs = spark.createDataFrame([(1, "one two three four five", "x", "y")], "doc_id long, text string, leaks_0 string, leaks_1 string")
    bench = spark.createDataFrame([(i, "one two three four five" + " more" * i) for i in range(3)], "item_id long, text string")
    (row,) = decontamination.find_leaks(docs, bench, docs.columns).collect()
    assert (row.leaks_0, row.leaks_1) == ("x", "y") and {m.item for m in row.leaks} == {"0", "1"}


def test_decontamination_of_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four FIVE"), (2, None), (None, "a b c d e f"), (3, ""), (4, "short one"), (1, "one two three four FIVE")], "item_id long, text string")
    left = decontamination.decontaminate(odd_documents, bench)
    assert left.columns == odd_documents.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 7: 1})  # null, blank and other texts
    assert decontamination.decontaminate(no_documents, bench).count() == 0
    assert decontamination.decontaminate(odd_documents, bench.limit(0)).count() == odd_documents.count()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 4)
    assert decontamination.leaks_by_document(odd_documents, bench).count() == 2
