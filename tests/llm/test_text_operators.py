import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination, language, line_dedup, media, ngram_join, packing, paragraph_dedup, pii, queries, suffix_dedup, url_filter
from tessera.llm.shared import text_blocks

from .conftest import DATA


# ---- line dedup

def _line_brute(rows, sites):
    spread, first = defaultdict(set), {}
    for i, text, source in rows:
        for p, line in enumerate(text.split("\n") if text is not None else []):
            k = line.strip(" \t\r")
            if k:
                spread[k] |= {source} - {None}
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, text, _ in rows:
        if text is not None:
            out[i] = "\n".join(x for p, x in enumerate(text.split("\n")) if len(spread[x.strip(" \t\r")]) < sites or first[x.strip(" \t\r")] == (i, p))
    return out


def test_boilerplate_leaves_except_for_its_first_place(spark):
    rows = [(i, f"own {i}\n ad \nshared by three\n\nad", f"s{i % 12}") for i in range(30)]
    rows += [(100 + i, "shared by three", f"s{i}") for i in range(3)] + [(200, "ad", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept_text for r in line_dedup.remove_boilerplate(docs, min_sites=10).collect()}
    assert got == _line_brute(rows, 10)
    assert got[200] == "" and got[0].count("ad") == 1


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(n * 100 + i, f"line {n}", f"site {i}") for n in range(5, 16) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.remove_boilerplate(docs, keep_first=False).where("n_removed > 0").select((F.col("doc_id") / 100).cast("int").alias("n")).distinct()
    assert sorted(r.n for r in got.collect()) == list(range(10, 16))


def test_lines_of_odd_rows(spark, odd_documents, no_documents):
    got = line_dedup.remove_boilerplate(odd_documents, min_sites=2, keep_first=False).collect()
    by = {(r.doc_id, r.source): r for r in got}
    assert len(got) == odd_documents.count()
    assert by[1, None].kept_text is None and by[1, None].n_lines == 0
    assert by[5, "b"].kept_text == "" == by[6, "c"].kept_text and by[None, "b"].kept_text == "mail a@b.org now"
    assert line_dedup.remove_boilerplate(no_documents).count() == 0


# ---- media

def test_media_round_trip(documents):
    got = {r.doc_id: r for r in media.digests(media.media_columns(documents)).collect()}
    for row in documents.collect():
        content = (row.text or "").encode()
        payload = content + bytes(max(64, math.ceil(len(content) / 64) * 64) - len(content))
        r = got[row.doc_id]
        png = media.encode_png(content)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(content), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == media.features(np.frombuffer(payload, np.uint8).reshape(-1, 64))


def test_media_of_odd_rows(odd_documents, no_documents):
    got = media.digests(media.media_columns(odd_documents)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_documents.collect())
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert all((r.n_bytes, r.payload_bytes) == (0, 64) for r in empty) and len({r.media_sha256 for r in empty}) == 1
    assert media.media_columns(no_documents).count() == 0


def test_damaged_member_is_reported_alone(spark, documents, tmp_path):
    from pathlib import Path

    where = str(tmp_path / "archive")
    media.write_media(documents.limit(20), "doc_id", "text", where)
    whole = media.read_media(spark, where, split_bytes=4096).cache()
    assert whole.where("error is null").count() == 20 and whole.select("member").distinct().count() == 20
    victim = whole.orderBy("offset").first()
    path = Path(where, victim.archive)
    raw = bytearray(path.read_bytes())
    raw[victim.offset + 120] ^= 255
    path.write_bytes(raw)
    bad = media.read_media(spark, where, retries=1).where("error is not null").collect()
    assert [(r.archive, r.member) for r in bad] == [(victim.archive, victim.member)]


@given(st.binary(max_size=1000))
@settings(max_examples=50, deadline=None)
def test_png_round_trip(content):
    samples, length = media.decode_png(media.encode_png(content))
    assert samples.tobytes()[:length] == content and not any(samples.tobytes()[length:])


# ---- urls

def _url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host):])[0]


def _rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_match_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in queries.op3_url_filters(spark, DATA).collect()}
    for r in pages.collect():
        host, path = _url_parts(r.url)
        rule, action = _rule(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert action is None or g.verdict == action


def test_blocks_reach_aliases_unless_allowed(spark):
    link = '<LINK href="{}" rel=canonical>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://bad.net/a", ""), (2, "http://x.com/1", link.format("http://bad.net/a")), (3, "http://y.com/1", refresh.format("http://x.com/1")),
        (4, "http://x.com/2", ""), (5, "http://www.example.net/en/q", link.format("http://bad.net/a")),
        (6, "http://z.com/9#top", ""), (7, None, None), (8, "no scheme", "<p>"), (9, "http://z.com/8", link.format("//bad.net/b")), (9, "http://z.com/8", link.format("//bad.net/b")),
        (10, "HTTP://A.Org?x", None), (11, "http://bad.net/b", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("root", F.lit(1))
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert got == [
        (1, "net/", "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "example.net/en/", "allow"),
        (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "block"), (9, None, "block"), (10, None, "allow"), (11, "net/", "block"),
    ]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# ---- language

def test_language_is_right_on_held_out_documents(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.where("held_out and lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").toPandas()
    assert held.ok.mean() > 0.97
    assert abs(held.ok.mean() - held.score.mean()) < 0.05
    for r in got.select("doc_id", "held_out", "score").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_language_of_odd_rows(odd_documents, no_documents):
    got = language.identify(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert language.identify(no_documents).count() == 0
    assert {r.lang_pred for r in language.identify(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_run_by_run_counts_equal_those_of_the_whole(monkeypatch):
    grams = language.NGrams()
    text = "Wie geht es dir, mein Freund? " * 20
    whole = grams.counts(text)
    for text in (text, "!! " * 50 + "a" + " " * 100 + "b", "x" * 129, "ab"):
        monkeypatch.setattr(language, "RUN_CHARS", 1 << 20)
        whole = grams.counts(text)
        for run in (1, 2, 7, 64):
            monkeypatch.setattr(language, "RUN_CHARS", run)
            part = grams.counts(text)
            assert all((x == y).all() for x, y in zip(part, whole, strict=True))


def _plain_grams(text):
    """Counts of hashed n-grams, character by character."""
    shown = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " "
    shown = re.sub(" +", " ", shown)
    codes = [0 if c == " " else ord(c) for c in shown]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            key = 0
            for c in codes[i : i + n]:
                key = (key * 0x01000193) % 2**32 ^ c
            out[((key + n) * 0x9E3779B1) % 2**32 >> 17] += 1
    return out


def test_language_model_equals_plain_loops(spark):
    rng = np.random.default_rng(4)
    pools = {"xx": "abcde", "yy": "cdefg", "zz": "éfghi"}
    rows = [(i, " ".join("".join(rng.choice(list(pools[k]), 4)) for _ in range(rng.integers(1, 12))), k) for i in range(30) for k in pools]
    rows += [(100, rows[0][1], "xx"), (101, None, "xx"), (102, "12 !", "yy"), (103, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    learnt = [(t, k) for _, t, k in rows if k and t is not None and any(c.isalpha() for c in t)]
    df = Counter(g for t, _ in learnt for g in _plain_grams(t))
    idf = lambda g: math.log((1 + len(learnt)) / (1 + df[g])) + 1

    def weighed(text):
        x = {g: (1 + math.log(n)) * idf(g) for g, n in _plain_grams(text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in sorted(x.items())}

    order = {(r.text, r.lang): r.h for r in docs.select("text", "lang", F.xxhash64(F.lit(7), "text").alias("h")).collect()}
    sample = [(weighed(t), sorted(pools).index(k)) for t, k in sorted(set(learnt), key=lambda x: (order[x], x[1]))]
    held = len(sample) // 5
    z, n = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)

    def weight(g, k):
        sign = (z[g][k] > 0) - (z[g][k] < 0)
        return -sign * max(abs(z[g][k]) - language.L1, 0) / ((language.BETA + math.sqrt(n[g][k])) / language.ALPHA + language.L2)

    def odds(x, t=1.0):
        score = [math.exp((sum(v * weight(g, k) for g, v in x.items()) + weight("bias", k)) / t) for k in range(3)]
        return [s / sum(score) for s in score]

    for _ in range(language.EPOCHS):
        for x, label in sample[held:]:
            p = odds(x)
            old = {(g, k): weight(g, k) for g in [*x, "bias"] for k in range(3)}
            for g, v in [*x.items(), ("bias", 1.0)]:
                for k in range(3):
                    slope = v * (p[k] - (k == label))
                    sigma = (math.sqrt(n[g][k] + slope**2) - math.sqrt(n[g][k])) / language.ALPHA
                    z[g][k] += slope - sigma * old[g, k]
                    n[g][k] += slope**2
    assert np.allclose(model.bias, [weight("bias", k) for k in range(3)], atol=1e-4)
    assert all(np.allclose(model.weights[g], [weight(g, k) for k in range(3)], atol=1e-4) for g in df)
    assert set(np.abs(model.weights).sum(1).nonzero()[0]) <= set(df) and (model.weights == 0).any(1)[sorted(df)].any()
    loss = lambda t: -sum(math.log(odds(x, t)[k]) for x, k in sample[:held])
    assert loss(model.temperature) <= min(loss(0.05 * 1.01**i) for i in range(600)) + 1e-3
    got = {r.doc_id: r for r in language.predict(docs.where("doc_id >= 100"), model, ["doc_id"]).collect()}
    p = odds(weighed("abc"), model.temperature)
    assert got[103].lang_pred == sorted(pools)[int(np.argmax(p))] and abs(got[103].score - max(p)) < 1e-4
    assert got[101].lang_pred == got[102].lang_pred == "und"


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def _base(text):
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and _luhn(re.sub("[^0-9]", "", s)), "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_pii_of_all_documents_equals_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op7_pii(spark, "/root/testdata/sf0.01").collect()}
    for d in docs:
        want = _base(d.text or "")
        n = Counter(k for k, _, _ in want)
        r = got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE)
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and r.spans.startswith(shown)


@given(st.text(alphabet="a@.0123+-() %é\n", max_size=60))
@settings(max_examples=3000, deadline=None)
def test_pii_equals_the_patterns_on_odd_text(text):
    assert [x for x in FIND(text) if x[0] in pii.BASE] == _base(text)


FIND = pii.Finder()


def test_pii_additions(spark, odd_documents, no_documents):
    text = "see ftp://joe:pw@host.org/x or jane.doe [at] example [dot] org; token = 'ab12cd34ef' IBAN: GB82 WEST 1234 5698 7654 32."
    assert [(k, text[s:e]) for k, s, e in FIND(text) if k not in pii.BASE] == [
        ("address", "ftp://joe:pw@host.org"), ("address", "jane.doe [at] example [dot] org"), ("account", "ab12cd34ef"), ("account", "GB82 WEST 1234 5698 7654 32"),
    ]
    found = pii.find_pii(odd_documents)
    assert {r.doc_id: len(r.spans) for r in found.collect()}[None] == 1
    assert "mail [email] now" in [r.text for r in pii.redact(odd_documents).collect()]
    assert pii.find_pii(no_documents).count() == 0


# ---- packing

def _check_packing(rows, docs, length=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d in docs:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and len(parts) == max(1, math.ceil(len(ids) / length))
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == length for r in parts[1:])
    assert not by
    for places in seqs.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(seqs), sum(r.length for r in rows)


def test_packing_holds_every_id_once(spark, documents):
    used, total = _check_packing(queries.op10_best_fit_packing(spark, DATA).collect(), documents.collect())
    assert used <= math.ceil(total / 1024) + 2


def test_packing_of_odd_rows(odd_documents, no_documents):
    one_each = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    _check_packing(packing.pack_documents(one_each).collect(), one_each.collect())
    assert packing.pack_documents(odd_documents).where("piece = 0").count() == odd_documents.count()
    assert packing.pack_documents(no_documents).count() == 0


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    return packing.Ids(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())


CONTROL = "".join(map(chr, [*range(32), 127]))


@given(st.lists(st.text(alphabet="ab' \n\t1é.,ß日\x85\xa0\u2003\u3000😀<|>-" + CONTROL, max_size=40) | st.just("a<|endoftext|> \n\nb"), max_size=4))
@settings(max_examples=2000, deadline=None)
def test_ids_equal_those_of_the_whole_text(ids, texts):
    fast, tokenizer = ids
    texts = [*texts, "a\0b c"]
    for _, _, raw, bounds in text_blocks(pa.array(texts)):
        found, of = fast(raw, bounds)
    assert [x.tolist() for x in np.split(found, of[1:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_rows_are_dealt_to_all_shards(spark):
    docs = spark.createDataFrame([(1, "the same words")] * 400, "doc_id long, text string")
    got = packing.pack(packing.pieces(docs, ["doc_id"]), ["doc_id"], shard=50)
    assert got.select(F.col("sequence_id") % 8).distinct().count() == 8 and got.count() == 400


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_sum_of_squares_takes_the_best_place(sizes):
    bins, offsets, made = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    left: dict[int, int] = {}
    for size, b, o in zip(sizes, bins, offsets, strict=True):
        def cost(gap_from, gap_to, left=left):
            n = Counter(g for g in left.values() if 0 < g < 20)
            if gap_from is not None:
                n[gap_from] -= 1
            n[gap_to] += 1
            return sum(v * v for g, v in n.items() if 0 < g < 20)
        options = [cost(g, g - size) for g in set(left.values()) if g >= size] + [cost(None, 20 - size)]
        taken = cost(left[b], left[b] - size) if b in left else cost(None, 20 - size)
        assert taken == min(options) and o == 20 - left.get(b, 20)
        left[b] = left.get(b, 20) - size
        assert left[b] >= 0


# ---- names that clash, long texts, exact ids

def test_columns_of_clashing_names_pass(spark, odd_documents):
    names = ["_gone", "_hit_doc", "_hit_text", "doc", "key", "gone", "_url", "url_2", "_k1", "k1", "k2", "_found", "found", "row", "_row", "shard", "place"]
    docs = odd_documents.withColumns({c: F.lit(c) for c in names})
    for got in (line_dedup.remove_boilerplate(docs), suffix_dedup.repeated_spans(docs), pii.find_pii(docs)):
        rows = got.collect()
        assert len(rows) == docs.count() and all(r[c] == c for r in rows for c in names)
    pages = docs.select(F.lit("http://a.net/x").alias("url"), F.lit("<p>").alias("html"), "doc_id", *names)
    assert all(r[c] == c for r in url_filter.filter_urls(pages).collect() for c in names)
    assert suffix_dedup.remove_repeats(docs, ["doc_id", *names]).count() == docs.count()
    assert packing.pack(packing.pieces(docs, ["doc_id", "shard", "_row"]), ["doc_id", "shard", "_row"]).count() > 0


def test_very_long_texts(spark):
    long = " ".join("w%x" % (i * 7919 % 65537) for i in range(900_000)) + "\n" + "x" * 100_000
    assert len(long) > 5_000_000
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "short and plain words here", "en", "b"), (3, long, "en", "c")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.n_lines for r in line_dedup.remove_boilerplate(docs).collect()} == {1: 2, 2: 1, 3: 2}
    assert {r.doc_id: r.n_bytes for r in media.digests(media.media_columns(docs)).collect()}[1] == len(long)
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digests(docs).collect()} == {1: len(long), 2: 0, 3: len(long)}
    assert {r.doc_id: r.n_repeated > 0 for r in paragraph_dedup.remove_repeated_paragraphs(docs, verbatim=True).collect()} == {1: True, 2: False, 3: True}
    item = " ".join(long.split()[200_000:200_030])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks_by_document(docs, bench).collect()} == {1, 3}
    assert pii.find_pii(docs).count() == 3 and language.identify(docs).count() == 3
    _check_packing(packing.pack_documents(docs.limit(2)).collect(), docs.limit(2).collect())
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>" + long + "<link rel=canonical href=c>")], "page_id long, url string, html string")
    assert url_filter.link_edges(pages).count() == 2


def test_ids_of_media_come_back_as_they_are(spark):
    ids = ["", "a\0b", "a/b.png", "\u00fc-\u65e5", None]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id string, text string")
    assert {(r.doc_id, r.n_bytes) for r in media.digests(media.media_columns(docs)).collect()} == {(i, 6) for i in ids}


def test_stored_images_are_png():
    """Read chunk by chunk, apart from the module's own decoder."""
    content = bytes(range(200))
    data, at, pixels = media.encode_png(content), 8, b""
    assert data.startswith(b"\x89PNG\r\n\x1a\n")
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert int.from_bytes(data[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            assert (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:]) == (64, 4, 8, 0, 0, 0, 0)
        pixels += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = zlib.decompress(pixels)
    assert b"".join(rows[i * 65 + 1 : (i + 1) * 65] for i in range(4)) == content + bytes(56)


@pytest.mark.parametrize(("link", "want"), [
    ("c", "http://a.org/x/c"), ("../c?q#f", "http://a.org/c?q#f"), ("./", "http://a.org/x/"), ("..", "http://a.org/"), ("?q=1", "http://a.org/x/y?q=1"), ("#top", None),
    ("/d/./e/../f", "http://a.org/d/f"), ("//b.net/z", "http://b.net/z"), ("https://c.com/a/../b", "https://c.com/a/../b"), ("mailto:a@b.org", None), ("../../../u/", "http://a.org/u/"), ("", None),
])
def test_links_are_resolved(spark, link, want):
    pages = spark.createDataFrame([("http://A.org/x/y?z", f'<link rel="canonical" href="{link}">')], "url string, html string")
    assert {r.b for r in url_filter.link_edges(pages).collect()} - {"https://a.org/x/y?z"} == ({want} if want else set())


def test_a_block_reaches_aliases_by_relative_links(spark):
    pages = spark.createDataFrame([
        (1, "http://example.com/en/a", '<link rel="canonical" href="../de/a">'), (2, "http://example.com/en/b", '<link rel="canonical" href="c">'), (3, "http://example.com/en/c", ""),
    ], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_attributes_in_any_order_and_a_base(spark):
    """Against SQL too, whose tables hold no such page."""
    import duckdb
    import pandas as pd

    from tessera.llm import sql

    pages = pd.DataFrame([
        (1, "http://a.org/x/1", "<META content='0; URL=http://t.net/r' HTTP-EQUIV=refresh>"), (2, "http://a.org/x/2", '<base target=_top><base href="/deep/er/"><link href="../c" rel="canonical">'),
        (3, "http://a.org/x/3", '<base href="http://other.net/en/"><link rel=canonical href=here>'), (4, "http://a.org/x/4", '<meta http-equiv="refresh" content="5; url=?q=1"><base href="//b.org/p/q">'),
        (5, "http://a.org/x/5", '<base href="http://other.net/en/">'), (6, "http://a.org/x/6", '<meta http-equiv="x-refresh" content="0; url=http://t.net/"><meta charset=utf-8>'), (7, "no scheme", "<link rel=canonical href=y>"),
    ], columns=["page_id", "url", "html"])
    edges = {(r.a, r.b) for r in url_filter.link_edges(spark.createDataFrame(pages)).collect() if r.b != url_filter.LOWER and not r.b.startswith("https://")}
    assert edges == {("http://a.org/x/1", "http://t.net/r"), ("http://a.org/x/2", "http://a.org/deep/c"), ("http://a.org/x/3", "http://other.net/en/here"), ("http://a.org/x/4", "http://b.org/p/q?q=1")}
    got = url_filter.filter_urls(spark.createDataFrame(pages)).select("page_id", "host", "path", "rule", "verdict")
    duck = duckdb.connect()
    duck.register("pages", pages)
    want = duck.sql(sql.URL_FILTER)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_pii_of_long_runs():
    zeros = "0" * 5000
    assert [x for x in FIND(f"{zeros}.1.1.1 {zeros}1.{zeros}.2.255") if x[0] == "ip"] == [("ip", 0, 5006), ("ip", 5007, 5007 + 5001 + 1 + 5000 + 6)]
    assert FIND(f"{zeros}999.1.1.1") == []
    long = f"x git+ssh://{'u' * 900}:{'p' * 900}@host.org y"
    assert [(k, s, e) for k, s, e in FIND(long) if k == "address"] == [("address", 2, len(long) - 2)]


def test_media_of_very_long_ids(spark):
    ids = ["k" * 65_534, "k" * 65_535, "\u00e9" * 50_000, "", "+"]
    docs = spark.createDataFrame([(i, f"text {len(i)}") for i in ids], "doc_id string, text string")
    assert sorted(r.doc_id for r in media.digests(media.media_columns(docs)).collect()) == sorted(ids)
