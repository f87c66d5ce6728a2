import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join, queries
from tessera.llm.shared import components


def _sets(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    """{id: (size, component)} by comparing every two documents that share a shingle."""
    sets = [(i, _sets(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for j, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(j)
    seen = set()
    for js in lists.values():
        for x in range(len(js)):
            for y in range(x + 1, len(js)):
                if (pair := (js[x], js[y])) not in seen:
                    seen.add(pair)
                    a, b = sets[js[x]][1], sets[js[y]][1]
                    if 100 * len(a & b) >= percent * len(a | b):
                        parent[find(js[x])] = find(js[y])
    smallest = {}
    for j, (i, _) in enumerate(sets):
        r = find(j)
        smallest[r] = min(smallest.get(r, i), i)
    return sorted((i, len(s), smallest[find(j)]) for j, (i, s) in enumerate(sets))


def _rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_join_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _rows(queries.op8_ngram_jaccard(spark, sf)) == brute(docs, 4, 85)


@pytest.mark.parametrize("short", [1, 3, 32])
def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    rng = random.Random(short)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(20)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 40, 90]))] + passage
        for _ in range(40):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[word()], [], [text[at], word()]])
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(ngram_join.similarity_groups(docs, k=2, percent=80)) == brute(rows, 2, 80)


def test_join_of_odd_rows(odd_documents, no_documents):
    got = ngram_join.similarity_groups(odd_documents).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[5] == [(2, 5)] * 2 and by[6] == [(2, 5)] and len(by[None]) == 1
    assert ngram_join.similarity_groups(no_documents).count() == 0


def test_near_copies_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:30], "x", *words[31:]])), (4, " ".join([*words, "end"]))]
    got = ngram_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.component_id for r in got} == {4}


def test_prefix_holds_the_rarest_tokens():
    tokens = np.unique(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    classes = np.zeros(ngram_join.COUNTERS, np.uint8)
    classes[tokens[:50] >> np.uint64(42)] = 3
    for order in range(3):
        found = ngram_join.prefix(tokens, classes, order, 80)
        assert len(found) == 21 and not set(found.tolist()) & set(tokens[:50].tolist())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 6), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(201)), list(range(1000, 1300)), [5000]]
    assert components(got.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    near, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    lone, nameless = "only here of all the rows there are", " ".join(f"n{i}" for i in range(30))
    rows = [
        # The smallest id stands in two equal rows, in one of other case and in an unrelated text of its own.
        (1, near), (1, near), (1, near.upper()), (1, other), (2, near + " more"), (None, near), (3, other + " more"),
        (4, lone), (None, nameless), (None, nameless), (None, nameless + " x"), (None, lone + " and not"),
        (5, ""), (5, ""), (6, None), (None, None), (None, None), (7, "short one"), (7, "short one"),
    ]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, key string, leaves int")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each_group(docs).collect()), key=str)
    assert sum(i == 1 and t.lower() == near for i, t in got) == 1 and sum(i is None and (t or "").startswith(nameless) for i, t in got) == 1
    rest = [(i, t) for i, t in got if not (t or "").lower().startswith((near, nameless))]
    want = [(1, other), (4, lone), (None, lone + " and not"), (5, ""), (5, ""), (6, None), (None, None), (None, None), (7, "short one")]
    assert rest == sorted(want, key=str) and len(got) == len(want) + 2
    assert ngram_join.one_of_each_group(docs).columns == docs.columns and ngram_join.one_of_each_group(docs.limit(0)).count() == 0
