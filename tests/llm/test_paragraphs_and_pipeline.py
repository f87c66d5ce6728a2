import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
import pytest

import corpus_pipeline
from tessera.llm import decontamination, line_dedup, paragraph_dedup, queries
from tessera.llm.shared import ascii_words, mix64, word_hashes

from .conftest import DATA
from .test_ngram_join import brute
from .test_text_operators import _check_packing, _line_brute


def _units(text):
    """{first line: (lines, shingles as words)} of a text's paragraphs, line by line."""
    lines = [x.encode().lower().split() for x in (text or "").split("\n")]
    rows, run = [], []
    for p, w in enumerate([*lines, []]):
        if 0 < len(w) < 10:
            run.append(p)
            continue
        groups, left = [], []
        for i in run:
            left.append(i)
            n = sum(len(lines[j]) for j in left)
            even = not int(mix64(np.array([int(sum(map(int, word_hashes(lines[i]))) % 2**64)], np.uint64), 9)[0]) & 1
            if n >= 10 and (even or n >= 40):
                groups.append(left)
                left = []
        if sum(len(lines[j]) for j in left) >= 10:
            groups.append(left)
        elif left and groups:
            groups[-1] = groups[-1] + left
        rows += groups + ([[p]] if len(w) >= 10 else [])
        run = []
    words = {g[0]: (len(g), [w for j in g for w in lines[j]]) for g in rows}
    return {p: (n, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))) for p, (n, w) in words.items()}


def _clusters(rows):
    """Paragraph components by exact comparison of all that share a shingle: {(doc, line): (first doc, first line)}."""
    sets = {(i, p): s for i, text in rows for p, (_, s) in _units(text).items()}
    distinct = list(set(sets.values()))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for j, s in enumerate(distinct):
        for g in s:
            lists[g].append(j)
    seen = set()
    for js in lists.values():
        for a in range(len(js)):
            for b in range(a + 1, len(js)):
                if (js[a], js[b]) not in seen:
                    seen.add((js[a], js[b]))
                    x, y = distinct[js[a]], distinct[js[b]]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        parent[find(js[a])] = find(js[b])
    index = {s: j for j, s in enumerate(distinct)}
    first = {}
    for at, s in sorted(sets.items()):
        first.setdefault(find(index[s]), at)
    return {at: first[find(index[s])] for at, s in sets.items()}


def _removed(df):
    return {(r.doc_id, x.line): (x.first_doc, x.first_line) for r in df.collect() for x in r.removed}


def test_repeated_paragraphs_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {at: first for at, first in _clusters(rows).items() if at != first}
    got = _removed(queries.op4_substring_dedup(spark, sf))
    assert len(want) > 50 and set(got.items()) <= set(want.items()) and len(got) >= 0.998 * len(want)


@pytest.mark.parametrize("short", [2, 32])
def test_groups_of_near_paragraphs(spark, monkeypatch, short):
    monkeypatch.setattr(paragraph_dedup, "SHORT_LIST", short)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        base = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            base[rng.randrange(60)] = word()
        rows.append((i, "\n".join([" ".join(word() for _ in range(30)), " ".join(base), "short line"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {at: first for at, first in _clusters(rows).items() if at != first}
    found = paragraph_dedup.remove_repeated_paragraphs(docs)
    assert _removed(found) == want
    for r in found.collect():
        assert r.kept_text == "\n".join(x for p, x in enumerate(r.text.split("\n")) if (r.doc_id, p) not in want) and r.n_paragraphs == 2


def test_columns_of_clashing_names_pass(odd_documents):
    odd = odd_documents.withColumns({c: F.lit(c) for c in ("doc", "gone", "near", "paragraphs", "cut_", "text_key", "_gone", "_hit_doc", "hits", "N_Near")})
    for verbatim in (False, True):
        got = paragraph_dedup.remove_repeated_paragraphs(odd, verbatim=verbatim).collect()
        assert len(got) == odd.count() and all(r.gone == "gone" and r._hit_doc == "_hit_doc" and isinstance(r.n_near, int) for r in got)


def test_paragraphs_of_odd_rows(odd_documents, no_documents):
    line = "a line of ten words that both of them may have"
    odd = odd_documents.unionByName(odd_documents.limit(2).withColumns({"doc_id": F.lit(50) + F.col("doc_id"), "text": F.lit(line + "\n\n" + line.upper())}))
    found = paragraph_dedup.remove_repeated_paragraphs(odd)
    assert found.count() == odd.count()
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].kept_text is None and by[2].kept_text == "" and by[51].n_removed == 1 and by[52].kept_text == ""
    assert paragraph_dedup.remove_repeated_paragraphs(no_documents).count() == 0


def _repeated_runs(rows, size):
    """{id: words of a text that some other window-sized place of any text holds too}."""
    places = defaultdict(set)
    texts = {i: ascii_words(t) for i, t in rows}
    for i, w in texts.items():
        for s in range(len(w) - size + 1):
            places[tuple(w[s : s + size])].add((i, s))
    out = {i: set() for i in texts}
    for at in places.values():
        for i, s in at if len(at) > 1 else ():
            out[i] |= set(range(s, s + size))
    return out


def test_passages_inside_lines_and_over_short_lines(spark):
    rng = random.Random(3)
    words = lambda n: [("%06x" % rng.randrange(16**6)) for _ in range(n)]
    inside, short = words(60), words(64)
    wrap = lambda w: "\n".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))
    rows = [(i, " ".join([*words(70 + i), *inside, *words(70)])) for i in (1, 2, 3)]
    rows += [(4, wrap(words(40) + short + words(16))), (5, wrap(words(24) + short)), (6, " ".join(words(20) + short + words(9)))]
    rows += [(7, " ".join(words(300))), (8, "  " + " ".join(words(30) + inside[:49]) + "\n\nend")]
    got = {r.doc_id: r for r in paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), verbatim=True).collect()}
    assert {i: r.n_repeated for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0}
    want = _repeated_runs(rows, 50)
    for i, text in rows:
        first = i in (1, 4)
        own = [w for k, w in enumerate(text.split()) if first or k not in want[i]]
        assert got[i].kept_text.split() == own and sum(c.words for c in got[i].cut) == (0 if first else len(want[i]))
    assert got[8].kept_text == rows[7][1]


def test_passages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i for i, w in _repeated_runs(rows, 50).items() if w}
    clusters = _clusters(rows)
    several = {at for at, n in Counter(clusters.values()).items() if n > 1}
    size = {(i, p): sum(len(x.split()) for x in text.split("\n")[p : p + n]) for i, text in rows for p, (n, _) in _units(text).items()}
    want |= {i for (i, p), at in clusters.items() if at in several and size[i, p] >= 50}
    got = queries.op4_substring_dedup(spark, sf).collect()
    assert len(want) > 3 and {r.doc_id for r in got if r.n_repeated} == want


def test_short_lines_are_joined(spark):
    rng = random.Random(9)
    lines = lambda n: [" ".join("%05x" % rng.randrange(16**5) for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    verse = lines(9)
    edited = [*verse]
    edited[4] += " more"
    rows = [(1, "\n".join([*lines(3), "", *verse, "", *lines(2)])), (2, "\n".join([*verse, "", *lines(4)])), (3, "\n".join(["alone", "", *edited])), (4, "\n".join(lines(6)))]
    got = {r.doc_id: r for r in paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {at: first for at, first in _clusters(rows).items() if at != first}
    assert {(i, x.line): (x.first_doc, x.first_line) for i, r in got.items() for x in r.removed} == want
    assert got[2].n_removed > 0 and not any(v in got[2].kept_text for v in verse) and got[1].kept_text == rows[0][1]


def test_passages_of_odd_rows(odd_documents, no_documents):
    got = {r.doc_id: r for r in paragraph_dedup.remove_repeated_paragraphs(odd_documents, verbatim=True).collect()}
    # The long text repeats its three words: the copies that overlap the first window stay with it.
    assert got[4].n_repeated == 1 and got[4].kept_text.split() == ("wörd of many " * 4000).split()[: 52]
    assert got[1].kept_text is None and got[2].kept_text == "" and got[3].kept_text == "  \n\n " and got[5].n_repeated == 0
    assert paragraph_dedup.remove_repeated_paragraphs(no_documents, verbatim=True).count() == 0


def test_bands_reach_the_recall():
    assert paragraph_dedup.recall(0.8) > 0.999
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(300):
        tokens = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets += [tokens, np.concatenate([tokens[6:], rng.integers(0, 2**63, 6).astype(np.uint64)])]
    keys, sketch = paragraph_dedup.signatures(np.concatenate([np.sort(s) for s in sets]), np.arange(601) * 60)
    met = (keys[::2] == keys[1::2]).any(1).sum()
    far = [sum(bin(int(x) & (2**64 - 1)).count("1") for x in pair) for pair in sketch[::2] ^ sketch[1::2]]
    assert met >= 298 and max(far) <= paragraph_dedup.MAX_DIFFERENT and np.mean(far) < 16


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_duplicates", "decontamination", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, DATA)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            return rows, spark.createDataFrame(rows, docs.schema)
        return rows, out

    start = docs.collect()
    kept, docs = step("language", docs)
    assert len(kept) >= 0.97 * len(start) and all(any(c.isalpha() for c in r.text) for r in kept)

    lines = _line_brute([(r.doc_id, r.text, r.source) for r in kept], line_dedup.MIN_SITES)
    kept, docs = step("line_dedup", docs)
    assert {r.doc_id: r.text for r in kept} == {i: t for i, t in lines.items() if t.strip(" \t\r\n")}
    assert all(r.n_chars == len(r.text) for r in kept)

    groups = brute([(r.doc_id, r.text) for r in kept], 5, 80)
    kept, docs = step("near_duplicates", docs)
    assert {r.doc_id for r in kept} == {i for i, n, c in groups if n == 0 or i == c}

    items = [decontamination.words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept if all(decontamination.best_match(w, decontamination.words(r.text))[0] > int(0.2 * len(w)) for w in items)}
    assert len(clean) < len(kept)
    kept, docs = step("decontamination", docs)
    assert {r.doc_id for r in kept} == clean

    packed, _ = step("packing", docs)
    _check_packing(packed, kept)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == Counter(r.doc_id for r in packed)


def test_stages_of_odd_rows(spark, odd_documents, no_documents):
    odd = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, DATA).count() == 0
        assert stage(spark, odd, DATA).count() > 0, name
