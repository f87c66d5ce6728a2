"""Literal expected rows of operators that SQL does not cover, and of corner cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tables as tx
from tessera.functions import text as fx
from tessera.operators import aggregates, filters, joins, kernels, models, sequences, sketches, trees, windows
from tessera.sources import readers, writers
from tessera.streaming import incremental


def one(spark, expr_of, value):
    return spark.createDataFrame([(value,)], "x string").select(expr_of(F.col("x")).alias("y")).first().y


def test_missing_required_column_fails(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "c"))
    assert readers.read_csv_required_columns(spark, str(tmp_path / "c"), ["v"]).collect()[0].v == "a"
    with pytest.raises(ValueError, match="missing columns: w"):
        readers.read_csv_required_columns(spark, str(tmp_path / "c"), ["v", "w"])


def test_corrupt_rows_are_kept(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b\n1;x\nno;y\n")
    got = readers.read_delimited(spark, str(tmp_path / "f.csv"), "a int, b string").collect()
    assert [(r.a, r._corrupt_record) for r in got] == [(1, None), (None, "no;y")]


def test_inventory_reads_no_content(spark, tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    for name in ("d/a.TXT", "d/b.bin", "d/.git/c.txt"):
        (tmp_path / name).write_text("abc")
    df = readers.scan_file_inventory(spark, str(tmp_path), ["txt"], ignored_dirs=r"\.git")
    assert [(r["name"], r.ext, r["size"]) for r in df.collect()] == [("a.TXT", "txt", 3)]


def test_glob_rules(spark):
    assert one(spark, lambda c: filters.should_track(c, [], ["*.md"]), "src/A.py") is True
    assert one(spark, lambda c: filters.should_track(c, ["*.py"], ["SRC/*"]), "src/a.py") is False
    assert one(spark, lambda c: filters.matches_any(c, ["[!a]?.py"]), "x/bb.py") is True


def test_year_needs_its_own_digits(spark):
    for name, has in (("Movie 1999", True), ("x11999", False), ("2160p", False), ("(2001)", True)):
        assert one(spark, filters.has_year, name) is has


def test_bibliography_entries_without_key_are_dropped(spark):
    df = spark.createDataFrame([("@Article{k1, title = {a}, year = 1}\n@misc{, x = 1}\n@book{k2, author={b}}",)], "t string")
    got = filters.bib_entries(df, "t", {"article": ["title", "author"], "book": ["author", "year"]}).collect()
    assert [(r.type, r.citekey, r.missing) for r in got] == [("article", "k1", ["author"]), ("book", "k2", ["year"])]
    assert [r.citekey for r in tx.bib_entries(df, "t").collect()] == ["k1", "k2"]


def test_stream_flags(spark):
    df = spark.createDataFrame([(1, {"forced": "Yes"}, "main", {}), (2, {"forced": "0"}, "FORCED subs", {}), (3, None, None, {"title": "forced"}), (4, {}, "main", None)], "i int, d map<string,string>, t string, g map<string,string>")
    got = df.select("i", filters.stream_flagged(F.col("d"), "forced", [F.col("t")], F.col("g"), ["forced"]).alias("f")).collect()
    assert [r.f for r in got] == [True, True, True, False]


def test_fuzzy_groups_hold_each_source_once(spark):
    rows = [(1999, "a", "the long movie"), (1999, "b", "the long movie"), (1999, "c", "the long moviee"), (1999, "b", "the long movies"), (2000, "a", "other"), (2000, "b", None)]
    pairs = joins.fuzzy_pairs(spark.createDataFrame(rows, "year int, source string, title string"), "year", "source", "title")
    assert pairs.where("ratio = 1").count() == 1
    groups = joins.assemble_groups(pairs, "year").collect()
    assert sorted((r.source, r.title) for r in groups) == [("a", "the long movie"), ("b", "the long movie"), ("c", "the long moviee")]


def test_unknown_language_stays_null(spark):
    df = spark.createDataFrame([("v1", "en"), ("v1", "pt"), ("v2", None)], "v string, language string")
    got = joins.required_tracks(df, df.where("language = 'en'"), df.where("language = 'pt'"), "v", ["en", "pt"])
    assert {(r.v, r.language): r.source for r in got.collect()} == {("v1", "en"): "embedded", ("v1", "pt"): "external", ("v2", "en"): None, ("v2", "pt"): None}


def test_source_symbols(spark):
    code = "import os\n\ndef a():\n    from json import loads\n    return b()\n\ndef b():\n    b()\n"
    df = tx.source_symbols(spark.createDataFrame([("f", code), ("g", "def ("), ("h", None)], "path string, source string"))
    got = {(r.file, r.kind, r["name"], r.container) for r in df.collect()}
    assert got == {("f", "import", "os", None), ("f", "def", "a", None), ("f", "import", "json", "a"), ("f", "call", "b", "a"), ("f", "def", "b", None), ("f", "call", "b", "b"), ("g", "error", "", None)}
    assert joins.unused_definitions(df).collect()[0]["name"] == "a"
    assert sorted((r.caller, r.callee) for r in joins.called_before_definition(df).collect()) == [("a", "b"), ("b", "b")]


def test_pair_free_interval_equals_all_pairs(spark):
    import itertools

    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = [float(a @ b) for a, b in itertools.combinations(u, 2)]
    r = aggregates.similarity_interval(spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>"), "v", 5).first()
    half = 1.9633 * np.std(cos, ddof=1) / np.sqrt(len(cos))
    assert r.n_pairs == len(cos) and abs(r["mean"] - np.mean(cos)) < 1e-9 and abs((r.high - r.low) / 2 - half) < 1e-4
    assert aggregates.similarity_interval(spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), "v", 2).first().high == 0.0


def plain_cosines(texts):
    """Cosines of all pairs of TF-IDF vectors, by dictionaries."""
    import itertools
    import re
    from collections import Counter

    counts = [Counter(re.findall(r"\w\w+", (t or "").lower())) for t in texts]
    held = Counter(w for c in counts for w in c)
    vectors = [{w: n * (np.log((1 + len(texts)) / (1 + held[w])) + 1) for w, n in c.items()} for c in counts]
    length = [sum(x * x for x in v.values()) ** 0.5 for v in vectors]
    return np.array([sum(x * b.get(w, 0) for w, x in a.items()) / (i * j or 1) for (a, i), (b, j) in itertools.combinations(zip(vectors, length, strict=True), 2)])


def test_text_similarity_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("w%d" % i for i in rng.zipf(1.4, rng.integers(1, 80)) if i < 10**6) for _ in range(150)]
    texts += [None, "", "!", "Ça va, ÇA_VA 42", texts[0], texts[0].upper(), "x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    want, r = plain_cosines(texts), sketches.text_similarity(df, "t").first()
    assert r.n_pairs == len(want) and abs(r["mean"] - want.mean()) < 1e-9
    assert abs(r.deviation / want.std(ddof=1) - 1) < 0.03
    assert abs((r.high - r.low) / 2 - 1.96 * r.deviation / len(want) ** 0.5) < 1e-5


def test_text_similarity_of_few_and_equal_texts(spark):
    of = lambda *texts: sketches.text_similarity(spark.createDataFrame([(t,) for t in texts], "t string"), "t").first()
    assert tuple(of()) == tuple(of("one text")) == (0, 0, 0, 0, 0)
    assert tuple(of(None, "", "?")) == (3, 0, 0, 0, 0)
    same = of(*["the same text"] * 20)
    assert same.n_pairs == 190 and abs(same["mean"] - 1) < 1e-9 and same.deviation < 1e-6


def test_tensor_sketches_keep_powers_of_products():
    """Without bias: the mean over sketches of several seeds nears the exact power."""
    x = np.random.default_rng(3).normal(size=(6, 9))
    for degree in (1, 2, 3):
        got = np.mean([(s := sketches.tensor_sketch(x, degree, 512, 10 * seed)) @ s.T for seed in range(30)], axis=0)
        scale = np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) ** degree
        assert np.abs(got - (x @ x.T) ** degree).max() < 0.05 * scale.max()


def test_intervals_are_clamped(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 5, 3, 9, 8, 8, 2, 4, 7])]
    got = windows.paired_intervals(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i", "v").collect()
    assert sorted((r.start, r.end) for r in got) == [(1, 5), (5, 9)]


def test_names_and_numbers(spark):
    assert str(one(spark, fx.brl_money, "R$ 1.234,56")) == "1234.56"
    assert one(spark, fx.clean_song, "Ke$ha (feat. X) [HD] 1999 - Remastered 2011") == "Kesha"
    assert one(spark, fx.without_trailing_index, "Song 12") == "Song" and one(spark, fx.without_trailing_index, "12 13") == "12 13"
    assert one(spark, fx.season_episode, "Show S1E5").episode == "05" and one(spark, fx.season_episode, "nothing").season is None
    assert one(spark, fx.repositioned_tokens, "HDR A Movie 1999 x") == "A Movie 1999 HDR x"
    assert one(spark, fx.clock_ms, "-00h01m02s0500ms") == -62500 and one(spark, fx.clock_ms, "1:02:03") == 3723000 and one(spark, fx.clock_ms, "x") is None
    assert one(spark, lambda c: fx.between(c, "<a>", "</a>"), "x<a>1</a>") == "<a>1</a>" and one(spark, lambda c: fx.between(c, "<a>", "</a>"), "x<a>1") is None
    assert one(spark, fx.tag_family, "film_pt.cleaned_en") == "film"
    assert one(spark, lambda c: fx.formatted_duration(c.cast("long")), "93780") == "1d 2h 3m"
    assert one(spark, lambda c: fx.without_descriptive_fragments(c, ["door slams"], ["music"], ["loud"]), "Hi [door slams] (loud music) (1 music)") == "Hi (1 music)"


def test_cues(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\nHello there.\n\nbroken\nblock\n\n2\n00:01:00,000 --> 00:01:01,000\na\nb\n"
    got = tx.explode_cues(spark.createDataFrame([("d", text)], "doc string, text string"), "text").orderBy("pos").collect()
    assert [(r["index"], r.start_ms, r.end_ms, r.lines, r.valid) for r in got] == [(1, 1000, 2500, ["Hello there."], True), (None, None, None, ["broken", "block"], False), (2, 60000, 61000, ["a", "b"], True)]


def test_segments_are_found_trimmed_and_kept_once(spark):
    series = [(5, i, 0.99 if 10 <= i < 20 else 0.96 if 20 <= i < 22 else 0.1) for i in range(40)] + [(6, i, 0.97 if 11 <= i < 19 else 0.2) for i in range(40)]
    found = sequences.repeated_segments(spark.createDataFrame(series, "offset long, pos long, similarity double"), "pos", "similarity", 3, 0.95, 2, 0.9)
    assert sorted((r.offset, r["first"], r["last"]) for r in found.collect()) == [(5, 10, 21), (6, 11, 18)]
    kept = sequences.without_overlaps(found.withColumn("file", F.lit(1)), "file").collect()
    assert [(r.offset, r["first"]) for r in kept] == [(5, 10)]


def test_title_vectors_and_model_comparison(spark):
    titles = spark.createDataFrame([(i, w) for i, w in enumerate(["Red fox runs", "red fox sleeps", "stock market falls"] * 5)], "i int, t string")
    assert len(models.title_vectors(titles, "t", dims=8).first().vector) == 8
    rows = models.feature_rows(spark.createDataFrame([([float(i % 2), float(i % 3)], i % 2, i % 4 == 0) for i in range(60)], "f array<double>, y int, test boolean"), "f", "y")
    best = models.accuracies(models.compared(rows, ["decision_tree", "naive_bayes"], "test", 2, 2)).collect()
    assert [r.model for r in best] == ["decision_tree", "naive_bayes"] and best[0].accuracy == 1.0


def test_state_reasons_in_order(spark):
    cols = "version int, target string, blocks int, content string, prefix string"
    now = ", ".join(f"now_{c}" for c in cols.split(", "))
    rows = [(1, "t", 2, "c", "p", 1, "t", 2, "c", "p"), (1, "t", 3, "x", "p", 1, "t", 2, "c", "p"), (None, "t", 2, "c", "p", 1, "t", 2, "c", "p")]
    got = [r.r for r in spark.createDataFrame(rows, f"{cols}, {now}").select(incremental.state_reason().alias("r")).collect()]
    assert got == ["valid", "other number of blocks", "other version"]


def test_new_records_by_any_key(spark, tmp_path):
    """Late, repeated and empty arrivals, null keys; what a key turns down leaves no trace; a batch that runs again changes nothing."""
    import shutil

    from pyspark.sql import functions as F

    from tessera.streaming import keyed

    schema = spark.createDataFrame([], "i long, id string, url string").schema
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    job = keyed.KeyedDeduplication(spark, source, target, schema, ["id", "url"], "i", F.col("id").isNotNull(), progress)

    def arrive(rows):
        if rows is not None:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        job.run()
        return sorted(r.i for r in job.table().collect())

    assert arrive([(1, "a", "u"), (2, "a", "v"), (3, "b", "u"), (4, None, "w"), (5, "c", None), (6, None, None)]) == [1, 4, 5, 6]
    assert arrive(None) == [1, 4, 5, 6] == arrive([])
    # 7 repeats a url, so that its id b stays free for 8; w is free, since 4 was not complete; c is known.
    assert arrive([(7, "b", "u"), (8, "b", "x"), (9, "d", "w"), (10, "c", "y"), (8, "b", "x")]) == [1, 4, 5, 6, 8, 9]
    assert arrive([(0, "b", "z"), (1, "a", "u"), (11, "e", "y")]) == [1, 4, 5, 6, 8, 9, 11]  # late and repeated
    last = max(int(p.name) for p in (tmp_path / "progress" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "progress" / "commits" / name).unlink(missing_ok=True)
    assert arrive(None) == [1, 4, 5, 6, 8, 9, 11]  # the batch ran again
    assert arrive([(12, "e", "zz"), (13, "f", "x"), (14, "f", "zz")]) == [1, 4, 5, 6, 8, 9, 11, 14]
    shutil.rmtree(target)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unicode_folding(spark):
    from tessera.functions.folding import folded_title

    assert one(spark, folded_title, "Ünï_Straße №4 — ﬁn") == "uni strasse no4 fin" and one(spark, folded_title, None) is None


def test_blocks_give_the_nearest_of_all_rows(spark, monkeypatch):
    import numpy as np

    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "QUERY_BLOCK", 4)
    monkeypatch.setattr(blocks, "ROW_BLOCK", 7)
    v = np.random.default_rng(3).integers(-2, 3, size=(40, 3)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0])], "i int, v array<double>")
    for metric, score in (("dot", lambda a, b: a @ b), ("euclidean", lambda a, b: -((a - b) ** 2).sum()), ("manhattan", lambda a, b: -np.abs(a - b).sum())):
        got = {(r.query, r["rank"]): (r.other, r.score) for r in blocks.nearest(rows.where("i % 4 = 0"), rows, "i", "v", 5, metric).collect()}
        want = {}
        for q in range(0, 40, 4):
            best = sorted((-score(v[q], v[o]), o) for o in range(40) if o != q)[:5]
            want |= {(q, n): (o, -s) for n, (s, o) in enumerate(best, 1)}
        assert got == want
    assert blocks.nearest(rows.limit(0), rows, "i", "v", 5).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_metric_index_loses_no_neighbour(spark, metric):
    """Over clusters, ties, repeated ids and vectors and other lengths; cells hold a small part of all distances."""
    from tessera.operators import blocks

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 40, (8, 3))
    rows = [(i, (centres[i % 8] + rng.integers(-2, 3, 3)).round(1).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (401, rows[7][1]), (402, [1.0, 2.0]), (403, [1.0, 2.5]), (404, None), (405, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(3)
    asked = df.where("i % 5 = 0 or i > 400")
    both = [sorted(map(tuple, blocks.nearest(asked, df, "i", "v", 4, metric, pivots=p).collect())) for p in (0, 16)]
    assert both[0] == both[1] and len(both[0]) > 300
    side = lambda d, name: d.where("v is not null and forall(v, x -> x is not null)").select(F.col("i").alias(name), F.col("v").alias("_v"), F.size("v").alias("_size"))
    q, r = blocks._celled(side(asked, "_q"), side(df, "_r"), 4, metric, 16)
    meet = q.groupBy("_cell").agg(F.count("*").alias("n")).join(r.groupBy("_cell").agg(F.count("*").alias("m")), "_cell").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert meet < 0.5 * side(asked, "_q").count() * side(df, "_r").count()
    assert blocks.nearest(asked, df.limit(0), "i", "v", 4, metric, pivots=16).count() == 0 == blocks.nearest(asked.limit(0), df, "i", "v", 4, metric, pivots=16).count()


def test_intervals_over_many_ranges(spark):
    import bisect

    values, cuts = [i * 7 % 50 for i in range(200)] + [None], [10, 3, 30, 30, 49]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    marks = spark.createDataFrame([(c, f"t{n}") for n, c in enumerate(cuts)] + [(None, "none")], "cut int, tag string")
    got = joins.assign_intervals(rows, marks, "v", "cut", "tag").collect()
    name = {3: "t1", 10: "t0", 30: "t2", 49: "t4"}
    ends = sorted(name)
    for r in got:
        at = None if r.v is None else bisect.bisect_left(ends, r.v)
        assert r.tag == (name[ends[at]] if at is not None and at < len(ends) else None)
    for tag in {r.tag for r in got if r.v is not None}:
        numbers = [r.number for r in sorted((r for r in got if r.tag == tag and r.v is not None), key=lambda r: (r.v, r.number))]
        assert numbers == list(range(1, len(numbers) + 1))
    assert len(got) == 201 and [r.number for r in got if r.v is None] == [None]
    assert {r.tag for r in joins.assign_intervals(rows, marks.limit(0), "v", "cut", "tag").collect()} == {None}


def test_first_subtitle_by_name_or_episode(spark):
    movies = spark.createDataFrame([("d", "ab", 1), ("d", "longer name", 2), ("d", "", 9), ("e", "ab", 1), ("d", None, 3)], "dir string, stem string, episode int")
    subs = spark.createDataFrame([("d", "xx ab yy", 5, 4), ("d", "x", 1, 7), ("d", "a longer name", 8, 3), ("d", "z", 3, 6), ("e", "q", 4, 1), ("d", None, 1, 1)], "dir string, stem string, episode int, pos int")
    got = {(r.dir, r.movie): r.subtitle for r in joins.name_or_episode(movies, subs, "dir").collect()}
    assert got == {("d", "ab"): "xx ab yy", ("d", "longer name"): "a longer name", ("d", ""): "a longer name", ("d", None): "z"}


def test_json_over_lines_and_snapshot_folders(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{\n "issue_data": {\n  "title": "A"}}')
    assert readers.nested_issue_titles(readers.read_nested_json(spark, str(tmp_path / "j"), "issue_data struct<title: string>")).first().title == "A"
    for folder in ("12-ab-c", "commit=3-ff"):
        (tmp_path / "s" / folder).mkdir(parents=True)
        (tmp_path / "s" / folder / "f.csv").write_text("k\n1\n")
    assert sorted((r.commit_number, r.commit_hash) for r in readers.read_snapshots(spark, str(tmp_path / "s"), "k int").collect()) == [(3, "ff"), (12, "ab-c")]


def test_texts_are_read_whole_and_by_line(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one \n\n  zweiü\n".encode() + b"\xff\n")
    assert [r.line for r in readers.read_text_lines(spark, str(tmp_path)).collect()] == ["one", "zweiü", "�"]
    assert readers.read_whole_texts(spark, str(tmp_path)).first().text.startswith("one \n\n")


def test_reports_without_usable_vectors(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), (None,), ([1.0],), ([1.0, None],)], "v array<double>")
    assert aggregates.similarity_interval(rows, "v", 2).first().n_pairs == 0


@pytest.mark.parametrize("least", [0.9, 0.75, 0.6])
def test_fuzzy_pairs_are_those_of_all_pairs(spark, least):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    titles = ["", "a", "ab"] + ["".join(rng.choice("abü ") for _ in range(rng.randrange(3, 24))) for _ in range(30)]
    titles += ["".join(c for c in t if rng.random() > 0.06) + rng.choice(["", "b"]) for t in titles[3:]]
    rows = [(i % 2, rng.choice("xyz"), t) for i, t in enumerate(titles * 2)]
    got = joins.fuzzy_pairs(spark.createDataFrame(rows, "block int, source string, title string"), "block", "source", "title", least)
    want = {(b, s, t, s2, t2) for b, s, t in set(rows) for b2, s2, t2 in set(rows) if b == b2 and s < s2 and SequenceMatcher(None, t, t2, autojunk=False).ratio() >= least}
    found = [(r.block, r.source_a, r.title_a, r.source_b, r.title_b) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_naive_bayes_searches_priors_and_smoothing(spark):
    """Against plain loops: an uneven label, a feature without spread, a class that one fold alone holds, rows that count nowhere."""
    import math
    import random

    from tessera.operators import bayes

    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.2), i % 3, i % 7 == 0, [rng.gauss(0, 1), rng.gauss(i % 5, 3), 2.0]) for i in range(150)]
    rows = [(i, y, f, t, [v[0] + y, *v[1:]]) for i, y, f, t, v in rows] + [(200, 9, 0, False, [5.0, 5.0, 2.0]), (201, 9, 0, False, [5.5, 5.0, 2.0])]
    odd = [(300, 1, 0, False, None), (301, 1, 0, False, [1.0]), (302, None, 0, False, [1.0, 1.0, 1.0]), (303, 1, 0, True, [1.0, None, 1.0])]

    def plain(smoothing, priors, held):
        kept = [(y, v) for _, y, f, t, v in rows if not t and f != held]
        spread = lambda xs: sum(x * x for x in xs) / len(xs) - (sum(xs) / len(xs)) ** 2
        largest = max(spread([v[i] for _, v in kept]) for i in range(3))
        labels = sorted({y for y, _ in kept})
        asked = [(y, v) for _, y, f, t, v in rows if (t if held == -1 else not t and f == held)]
        hits = 0
        for y, v in asked:
            scores = {}
            for c in labels:
                mine = [w for z, w in kept if z == c]
                score = math.log(len(mine) / len(kept) if priors == "empirical" else 1 / len(labels))
                for i in range(3):
                    values = [w[i] for w in mine]
                    var = max(spread(values), 0) + smoothing * largest
                    score -= 0.5 * (math.log(2 * math.pi * var) + (v[i] - sum(values) / len(values)) ** 2 / var)
                scores[c] = score
            hits += max(labels, key=lambda c: (scores[c], -c)) == y
        return (smoothing, priors, held, len(asked), hits)

    table = spark.createDataFrame(rows + odd, "id int, label int, fold int, test boolean, x array<double>")
    got = {tuple(r) for r in bayes.grid_search(table, "label", "x", "fold", "test", smoothings=(1e-6, 0.1, 10.0)).collect()}
    want = {plain(s, p, held) for s in (1e-6, 0.1, 10.0) for p in bayes.PRIORS for held in (-1, 0, 1, 2)}
    assert got == want and len({h for *_, h in want}) > 4  # the grid has an effect
    assert bayes.grid_search(table.limit(0), "label", "x", "fold", "test").count() == 0


def test_prefix_join_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    stem = lambda: "".join(rng.choice("aB.-") for _ in range(rng.randrange(7)))
    mains = [(i, rng.choice("xy"), rng.choice([None, stem(), stem(), stem()])) for i in range(60)]
    sides = [(i, rng.choice("xyz"), rng.choice([None, stem(), stem(), stem()])) for i in range(120)]
    a, b = spark.createDataFrame(mains, "i int, dir string, stem string"), spark.createDataFrame(sides, "k int, dir string, side string")
    pairs = [(i, k, x.lower(), y.lower()) for i, d, x in mains for k, e, y in sides if d == e and x is not None and y is not None]
    want = {True: [(i, k) for i, k, x, y in pairs if y == x or y.startswith(x) and y[len(x) : len(x) + 1] in tuple(". -_")], False: [(i, k) for i, k, x, y in pairs if y.startswith(x)]}
    for strict in (True, False):
        got = joins.prefix_join(a, b, "dir", "stem", "side", strict)
        assert got.columns == ["dir", "i", "stem", "k", "side"] and sorted((r.i, r.k) for r in got.collect()) == sorted(want[strict]) and want[strict]


def test_neighbour_grid_equals_plain_votes(spark):
    import random
    from collections import Counter

    from tessera.operators import models

    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)], rng.randrange(3)) for i in range(90)]
    table = spark.createDataFrame([*rows, (500, None, 1), (501, [1.0], 1), (502, [1.0, None, 2.0], 1)], "id int, v array<double>, y int")
    got = {tuple(r) for r in models.neighbour_grid(table, table.where("id % 4 = 0"), "id", "v", "y").collect()}
    want = set()
    for metric in models.METRICS:
        power = 1 if metric == "manhattan" else 2
        for k in models.NEIGHBOURS:
            hits = 0
            for i, v, y in rows[::4]:
                near = sorted((sum(abs(a - b) ** power for a, b in zip(v, w, strict=True)), j, z) for j, w, z in rows if j != i)[:k]
                count, first = Counter(z for *_, z in near), {}
                for rank, (_, _, z) in enumerate(near):
                    first.setdefault(z, rank)
                hits += min(count, key=lambda z: (-count[z], first[z])) == y
            want.add((metric, k, 23, hits))
    assert got == want


def test_log_goes_on_behind_the_last_record(spark, tmp_path):
    """Stops inside a file, failing batches, arrivals between runs, empty arrivals and unfinished ones: each record once."""
    import json

    from tessera.streaming import records

    log, progress, target = (str(tmp_path / x) for x in ("log", "progress", "out"))
    schema = spark.createDataFrame([], "i long, s string").schema

    def arrive(name, ids):
        records.append_log(spark.createDataFrame([(i, f"r{i}") for i in ids], schema), log, name, ["i"])

    def run(limit=None, broken=False):
        def write(batch, n):
            batch.write.mode("overwrite").parquet(f"{target}/batch={n}")
            if broken:
                raise RuntimeError("stopped")

        records.resume(spark, log, schema, progress, write, limit)

    def written():
        return sorted((r.i, r.s) for r in spark.read.schema(schema).parquet(target).collect())

    arrive("a-0", range(100))
    run(37)
    assert written() == [(i, f"r{i}") for i in range(37)]
    run(20)  # before the progress: nothing comes back
    assert len(written()) == 37
    arrive("a-1", range(100, 150))
    with pytest.raises(Exception):
        run(broken=True)
    arrive("a-2", [])
    arrive("a-3", range(150, 160))
    (tmp_path / "log" / "a-4").mkdir()
    (tmp_path / "log" / "a-4" / "part-0.parquet").write_bytes(next((tmp_path / "log" / "a-3").glob("part-*.parquet")).read_bytes())  # no _SUCCESS
    run()
    run()
    assert written() == [(i, f"r{i}") for i in range(160)]
    offsets = sorted((tmp_path / "progress" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    assert json.loads(offsets[0].read_text().splitlines()[-1])["row"] < 100


def test_reindex_writes_touched_groups_behind_the_new_rows(spark, tmp_path):
    """Equal to an index from scratch after each arrival, null times, groups and repeated rows among them; runs hold no more than they must."""
    from tessera.operators.windows import chronological_index
    from tessera.streaming.reindex import GroupedIndex

    schema = spark.createDataFrame([], "g string, i long, t long, extra string").schema
    job = GroupedIndex(spark, str(tmp_path / "index"), schema, "g", "t", ["i"])
    rows = []

    def arrive(n, new, again=False):
        rows.extend([] if again else new)
        job.add(spark.createDataFrame(new, schema), n)
        got = sorted(map(tuple, job.index().collect()), key=str)
        want = chronological_index(spark.createDataFrame(rows, schema), "g", "t", ["i"]).collect()
        assert got == sorted(map(tuple, want), key=str)
        return spark.read.schema(job.runs).parquet(str(tmp_path / "index" / "runs")).where(f"_batch = {n}").count()

    groups = ["a", "b", None]
    assert arrive(0, [(g, i, i * 10, "x") for g in groups for i in range(120)]) == 360
    assert arrive(1, [("a", 200, 5000, "y")]) == 1  # at the end: nothing moves
    assert arrive(2, [("b", 201, 1175, None)]) == 3  # two records stand behind it
    assert arrive(2, [("b", 201, 1175, None)], again=True) == 3
    assert arrive(3, [(None, 202, None, "z"), (None, 203, 5, "z"), ("new", 1, 1, "z")]) == 122
    assert arrive(4, []) == 0
    assert arrive(5, [("a", 200, 5000, "y"), ("a", 200, 5000, "y")]) == 2  # repeated rows keep the first's place
    assert arrive(6, [(None, 204, 5, "z"), ("a", -1, None, "z"), ("b", 0, -1, "w")]) == 244  # 121 + 1 + 122


def test_segments_over_parts_equal_plain_loops(spark):
    """Parts of a few rows give what one pass over each offset gives: gaps in the positions, runs over many parts, runs at part ends."""
    rng = np.random.default_rng(4)
    series = []
    for offset in range(4):
        at = np.flatnonzero(rng.random(400) < (0.98 if offset else 0.8))
        level = np.repeat(rng.choice([0.2, 0.7, 0.9], 40, p=[0.3, 0.3, 0.4]), 10)
        series += [(offset, int(p), float(np.round(level[p] + rng.normal(0, 0.1), 4))) for p in at]
    series += [(9, p, 0.9) for p in range(150)]

    def plain(n, least, gap, edge):
        found = []
        for offset in sorted({s[0] for s in series}):
            rows = sorted(s[1:] for s in series if s[0] == offset)
            strong = [rows[i][0] for i in range(len(rows) - n + 1) if sum(r[1] for r in rows[i : i + n]) / n >= least]
            runs = []
            for p in strong:
                if runs and p - runs[-1][1] <= gap + 1:
                    runs[-1][1] = p
                else:
                    runs.append([p, p])
            for first, last in runs:
                held = [r for r in rows if first <= r[0] <= last + n - 1]
                good = [r[0] for r in held if r[1] >= edge]
                if good:
                    values = [r[1] for r in held if good[0] <= r[0] <= good[-1]]
                    found.append((offset, good[0], good[-1], 100 * sum(values) / len(values)))
        return found

    df = spark.createDataFrame(series, "offset long, pos long, similarity double").repartition(3)
    for stretch, block in ((7, 5), (50, 64), (10_000, 256)):
        got = sorted(map(tuple, sequences.repeated_segments(df, "pos", "similarity", 4, 0.65, 3, 0.8, stretch, block).collect()))
        want = plain(4, 0.65, 3, 0.8)
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 20
        assert all(abs(g[3] - w[3]) < 0.0051 for g, w in zip(got, want))


def test_overlaps_in_rounds_equal_one_by_one(spark):
    """The greedy choice in rounds, with ties, repeated records, records without length, null keys, long chains and a limit."""
    rng = np.random.default_rng(8)
    records = [(k, int(rng.integers(20, 26)), f, f + int(rng.integers(0, 40) ** 2 // 40), float(rng.integers(1, 4))) for k in (1, 2, None) for f in map(int, rng.integers(0, 90, 70))]
    records += records[:5] + [(3, 5, i, i + 1000 - i, 1.0) for i in range(0, 400, 2)]

    def plain(rows, most):
        kept = []
        for r in sorted(rows, key=lambda r: (r[2] - r[3], -r[4], r[1], r[2])):
            hit = False
            for q in kept:
                short = max(1e-9, min(r[3] - r[2], q[3] - q[2]))
                near = abs(r[2] - q[2]) <= 1.5 and abs(r[2] + r[1] - q[2] - q[1]) <= 1.5
                both = all(min(r[3] + a, q[3] + b) - max(r[2] + a, q[2] + b) >= 0.8 * short for a, b in ((0, 0), (r[1], q[1])))
                hit = hit or near or both
            if not hit and (most is None or len(kept) < most):
                kept.append(r)
        return kept

    df = spark.createDataFrame(records, "file long, offset long, first long, last long, confidence double").repartition(3)
    for most in (None, 6):
        got = sorted(map(tuple, sequences.without_overlaps(df, "file", most).collect()), key=str)
        want = [r for k in (1, 2, 3, None) for r in plain([x for x in records if x[0] == k], most)]
        assert got == sorted(want, key=str)
    assert sequences.without_overlaps(df.limit(0), "file").count() == 0


def test_places_within_keys_over_many_ranges(spark):
    """A key over many ranges, null keys and values, repeated rows and empty tables; the report's two folders hold every item."""
    from tessera.operators.numbering import numbered_within

    rows = [("hot", int(i) % 700, "x") for i in np.random.default_rng(2).permutation(900)] + [("a", None, "n"), ("a", 5, None), (None, 2, "n"), (None, 1, "n"), ("z", 1, "q")]
    df = spark.createDataFrame(rows, "k string, v long, extra string").repartition(5)
    got = numbered_within(df, ["k"], ["v"]).collect()
    for key in ("hot", "a", None, "z"):
        mine = sorted((r.place, r.v) for r in got if r.k == key) if key != "a" else [(r.place, r.v) for r in sorted((r for r in got if r.k == "a"), key=lambda r: r.place)]
        values = sorted((v for k, v, _ in rows if k == key), key=lambda v: (v is not None, v))
        assert mine == list(enumerate(values, 1)) and all(r.n == len(values) for r in got if r.k == key)
    assert len({r.k for r in got}) == 4 and numbered_within(df.limit(0), ["k"], ["v"]).count() == 0
    members = aggregates.duplicate_members(df, ["k"], "v").collect()
    assert len(members) == len(rows) - 1 and {(r.k, r.n, r.representative) for r in aggregates.duplicate_groups(df, "k", "v").collect()} == {("hot", 900, 0), ("a", 2, 5), (None, 2, 1)}


def test_report_of_two_folders(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x"), ("b", 1, None), (None, 7, "z")], "g string, i long, t string")
    writers.write_json_report(df, str(tmp_path), ["g"], ["t"], ["i"])
    items = spark.read.schema("g string, place long, item struct<i: long, t: string>").json(str(tmp_path / "items")).collect()
    assert sorted(((r.g or "", r.place, r["item"].i, r["item"].t) for r in items), key=str) == [("", 1, 7, "z"), ("a", 1, 1, "x"), ("b", 1, 1, None), ("b", 2, 2, "y")]
    assert {(r.g, r.summary.n) for r in spark.read.schema("g string, summary struct<n: long>").json(str(tmp_path / "summary")).collect()} == {(None, 1), ("a", 1), ("b", 2)}


def test_groups_in_rounds_equal_one_by_one(spark):
    """Ties, repeated pairs, many sources, chains, null blocks and no pairs at all."""
    rng = np.random.default_rng(6)
    rows = set()
    for b in (1, 2, None):
        for _ in range(90):
            i, j = sorted(rng.choice(6, 2, replace=False))
            rows.add((b, f"s{i}", f"t{rng.integers(5)}", f"s{j}", f"t{rng.integers(5)}", float(rng.choice([0.9, 0.95, 1.0]))))
    rows = list(rows) + list(rows)[:4] + [(3, f"c{i:02}", "t", f"c{i + 1:02}", "t", 0.9 + i / 1000) for i in range(9)]

    def plain(pairs):
        group = {}
        for _, sa, ta, sb, tb, _ in sorted(pairs, key=lambda p: (-p[5], p[1], p[3], p[2], p[4])):
            a, b = group.setdefault((sa, ta), {(sa, ta)}), group.setdefault((sb, tb), {(sb, tb)})
            if a is not b and not {s for s, _ in a} & {s for s, _ in b}:
                a |= b
                group.update(dict.fromkeys(b, a))
        return {frozenset(g) for g in group.values() if len(g) > 1}

    df = spark.createDataFrame(rows, "block long, source_a string, title_a string, source_b string, title_b string, ratio double").repartition(3)
    got = {}
    for r in joins.assemble_groups(df, "block").collect():
        got.setdefault(r.block, {}).setdefault(r.group, set()).add((r.source, r.title))
    for b in (1, 2, 3, None):
        assert {frozenset(g) for g in got[b].values()} == plain([r for r in rows if r[0] == b])
        assert sorted(got[b]) == list(range(len(got[b])))
    assert joins.assemble_groups(df.limit(0), "block").count() == 0


@pytest.mark.parametrize("name", ["decision_tree", "svm"])
def test_searches_by_folds_equal_plain_loops(spark, name):
    """Each grid point's accuracy is the mean over the folds of models fitted on the others; folds need not be numbered densely."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        label = int(rng.integers(3))
        rows.append((i, [float(label + rng.normal(0, 0.8)), float(rng.normal(0, 1)), float(label == 1) + float(rng.normal(0, 0.6))], label, int(rng.choice([0, 2, 7]))))
    df = models.feature_rows(spark.createDataFrame(rows, "i int, f array<double>, y int, fold int").coalesce(1), "f", "y").cache()
    _, best, points = models.searched(df, name, 3, 3)
    estimator, grid = models.grids(3, 3)[name]
    want = []
    for point in grid:
        hits = []
        for fold in (0, 2, 7):
            model = estimator.fit(df.where(F.col("fold") != fold), point)
            hits.append(model.transform(df.where(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        want.append(sum(hits) / 3)
    assert [round(p[1], 9) for p in points] == [round(w, 9) for w in want] and len({p[0] for p in points}) == len(grid)
    assert best == points[int(np.argmax([p[1] for p in points]))][0] and max(want) > 0.5
    with pytest.raises(ValueError):
        models.searched(df.where("fold = 2"), name, 3, 3)
    df.unpersist()


def test_title_vectors_are_means_of_words(spark):
    texts = ["fox", "Dog!", "fox dog", "DOG fox fox", "", None]
    got = {r.t: r.vector for r in models.title_vectors(spark.createDataFrame([(t,) for t in texts], "t string"), "t", dims=6).collect()}
    fox, dog = np.array(got["fox"]), np.array(got["Dog!"])
    assert np.allclose(got["fox dog"], (fox + dog) / 2, atol=1e-6) and np.allclose(got["DOG fox fox"], (2 * fox + dog) / 3, atol=1e-6)
    assert not np.any(got[""]) and np.any(fox)


def test_kernel_features_near_the_kernels():
    x = np.random.default_rng(2).normal(size=(40, 8))
    products, gaps = x @ x.T, ((x[:, None] - x[None]) ** 2).sum(2)
    exact = {"linear": products, "rbf": np.exp(-0.1 * gaps), "poly": (0.1 * products) ** 3}
    for kernel, want in exact.items():
        z = kernels.features(x, kernel, 0.1, 4096)
        assert np.abs(z @ z.T - want).max() < 0.15 * np.abs(want).max(), kernel
    z = kernels.features(x, "rbf", 0.1)
    assert np.sqrt(((z @ z.T - exact["rbf"]) ** 2).mean()) < 0.09


def plain_machine(x, y, asked, kernel, gamma, c, size):
    """Labels by the dual form: one linear system over the training rows a class, its kernel from the features."""
    mean, deviation = x.mean(0), x.std(0)
    deviation[deviation == 0] = 1
    z, q = (kernels.features((a - mean) / deviation, kernel, gamma or 1.0, size) for a in (x, asked))
    system = np.block([[np.zeros((1, 1)), np.ones((1, len(x)))], [np.ones((len(x), 1)), z @ z.T + np.eye(len(x)) / c]])
    labels = np.unique(y)
    scores = []
    for one in labels:
        solution = np.linalg.solve(system, np.concatenate([[0], np.where(y == one, 1.0, -1.0)]))
        scores.append(q @ z.T @ solution[1:] + solution[0])
    return labels[np.argmax(scores, 0)]


def test_kernel_machines_by_folds_equal_the_dual_form(spark):
    rng = np.random.default_rng(8)
    x = np.hstack([rng.normal(size=(160, 3)), np.ones((160, 1))])
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.5).astype(int) * 4 + (x[:, 2] > 1)  # a ring: no line parts it
    fold = rng.choice([0, 3, 4], 160)
    test = rng.random(160) < 0.25
    rows = [(v.tolist(), int(a), int(f), bool(t)) for v, a, f, t in zip(x, y, fold, test, strict=True)]
    odd = [(None, 1, 0, False), ([1.0, None, 0.0, 1.0], 1, 0, False), ([1.0], 1, 3, False), ([1.0, 1.0, 1.0, 1.0], None, 3, False)]
    df = spark.createDataFrame(rows + odd, "v array<double>, y int, fold int, test boolean").repartition(3)
    got = kernels.grid_search(df, "y", "v", "fold", "test", gammas=(0.1, 1.0), cs=(0.1, 10.0), size=64).cache()
    found = {(r.kernel, r.gamma, r.c, r.fold): (r.n, r.hits) for r in got.collect()}
    assert len(found) == (2 + 4 + 4) * 4
    for (kernel, gamma, c, h), (n, hits) in found.items():
        taught, asked = (~test & (fold != h), ~test & (fold == h)) if h >= 0 else (~test, test)
        want = plain_machine(x[taught], y[taught], x[asked], kernel, gamma, c, 64) == y[asked]
        assert (n, hits) == (len(want), want.sum()), (kernel, gamma, c, h)
    best = kernels.best_point(got).first()
    means = {k: np.mean([found[(*k, f)][1] / found[(*k, f)][0] for f in (0, 3, 4)]) for k in {k[:3] for k in found}}
    assert abs(best.accuracy - max(means.values())) < 1e-9 and best.kernel != "linear"
    n, hits = found[best.kernel, best.gamma, best.c, -1]
    assert abs(best.test_accuracy - hits / n) < 1e-9
    assert kernels.grid_search(df.limit(0), "y", "v", "fold", "test").count() == 0
    assert kernels.grid_search(df.where("fold = 3 and not test"), "y", "v", "fold", "test").count() == 0


def plain_tree(x, y, asked, criterion, depth, seed, node=1):
    """Labels of the asked rows by a tree that is grown row by row."""
    def cost(part):
        share = np.array([np.mean(part == c) for c in np.unique(part)])
        return len(part) * (1 - (share**2).sum() if criterion == "gini" else -(share * np.log2(share)).sum()) if len(part) else 0.0

    values, counts = np.unique(y, return_counts=True)
    if depth == 0 or len(values) == 1 or (x.min(0) == x.max(0)).all():
        return np.full(len(asked), values[np.argmax(counts)])
    cut = trees.thresholds(node, x.min(0), x.max(0), seed)
    costs = [round(cost(y[x[:, j] <= cut[j]]) + cost(y[x[:, j] > cut[j]]), 9) if x[:, j].min() < x[:, j].max() else np.inf for j in range(x.shape[1])]
    j = int(np.argmin(costs))
    out = np.zeros(len(asked), int)
    for side, (a, b) in enumerate([(x[:, j] <= cut[j], asked[:, j] <= cut[j]), (x[:, j] > cut[j], asked[:, j] > cut[j])]):
        out[b] = plain_tree(x[a], y[a], asked[b], criterion, depth - 1, seed, 2 * node + side)
    return out


def test_random_splits_equal_a_plain_tree(spark):
    rng = np.random.default_rng(21)
    x = np.hstack([rng.normal(size=(150, 2)).round(1), np.ones((150, 1)), rng.integers(0, 3, (150, 1))])
    y = (x[:, 0] > 0).astype(int) * 7 + (x[:, 3] == 1) + (rng.random(150) < 0.1)
    fold, test = rng.choice([0, 2, 5], 150), rng.random(150) < 0.2
    rows = [(v.tolist(), int(a), int(f), bool(t)) for v, a, f, t in zip(x, y, fold, test, strict=True)]
    odd = [(None, 1, 0, False), ([1.0, None, 0.0, 1.0], 1, 0, False), ([1.0], 1, 2, False), ([1.0] * 4, None, 2, False), ([1.0] * 4, 1, None, False)]
    df = spark.createDataFrame(rows + odd, "v array<double>, y int, fold int, test boolean").repartition(3)
    found = {(r.criterion, r.depth, r.fold): (r.n, r.hits) for r in trees.grid_search(df, "y", "v", "fold", "test", depths=(1, 3, 6)).collect()}
    assert len(found) == 2 * 3 * 4
    for (criterion, depth, h), (n, hits) in found.items():
        taught, asked = (~test & (fold != h), ~test & (fold == h)) if h >= 0 else (~test, test)
        want = plain_tree(x[taught], y[taught], x[asked], criterion, depth, 1) == y[asked]
        assert (n, hits) == (len(want), want.sum()), (criterion, depth, h)
    assert max(hits / n for n, hits in found.values()) > 0.6
    assert trees.grid_search(df.limit(0), "y", "v", "fold", "test").count() == 0
    assert trees.grid_search(df.where("fold = 2 and not test"), "y", "v", "fold", "test").count() == 0
