"""Each operator against brute force, a round trip or held-out accuracy, and its edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veritab.llm import ann, langid, licenses, minhash, mixing, packing, registry, sharding, simhash, token_store, warc
from veritab.llm._common import importable, scratch
from veritab.llm._tokens import U4, Encoder

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, label string"
LONG = "the quick brown fox jumps over a lazy dog near the old river bank " * 3000
ODD = [
    (1, None, None, None, None, 7, "x"),
    (2, "", "en", "a", 0, 7, "x"),
    (3, "same words here and there again and again", "en", "a", None, 7, "x"),
    (3, "same words here and there again and again", "en", "a", None, 7, "x"),
    (4, "same words here and there again and again", "de", None, None, 7, "x"),
    (None, "no id at all", "en", "b", None, 7, "x"),
    (5, LONG, "en", "b", None, 7, "x"),
    (6, "!!! 123 ???", None, "b", None, 7, "x"),
    (7, "Straße ÄÖ 中文 \U0001f600", "de", "b", None, 7, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    importable(spark)
    return spark.createDataFrame(ODD, DDL).cache()


@pytest.fixture(scope="session")
def empty(spark):
    importable(spark)
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark, sf):
    importable(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# 1 ---------------------------------------------------------------------------------------------

def near_brute(rows, k, is_query):
    ok = [(i, np.array(v, np.float32)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if is_query(q):
            best = {}
            for i, w in ok:
                if i != q and len(w) == len(v):
                    best[i] = max(best.get(i, -np.inf), float(v.astype(float) @ w.astype(float)))
            out[q] = sorted(best, key=lambda i: (-best[i], i))[:k]
    return out


def test_nearest_recall(spark, sf):
    got = ann.op1_nearest(spark, sf).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = near_brute(rows, 20, lambda i: i % 20 == 0)
    found = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
    recall = np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.99
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert len(con.execute(ann.ORACLE["op1_nearest"]).fetchall()) == len(got)


def test_nearest_ties_and_invalid(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [2.0, 1.0]), (61, [nan, 1.0]), (62, [inf, 1.0]), (63, None), (64, []), (65, [0.0, 0.0]), (66, [None, 1.0]), (67, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    want = near_brute(rows, 5, lambda i: i % 20 == 0)
    assert {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")} == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((2000, 64)).astype(np.float32), rng.standard_normal((50, 64)).astype(np.float32)
    m = ann.Model(v[:500], 4)
    cell, code, norm, own = m.encode(v)
    bits = np.packbits(np.unpackbits(code, axis=1), axis=1)
    assert bits.shape == (2000, 8)
    inside = []
    for c in range(len(m.centres)):
        at = cell == c
        guess, error = m.bounds(code[at], norm[at], own[at], m.centres[c], q)
        inside.append((np.abs(guess - v[at] @ q.T) <= error).ravel())
    assert np.concatenate(inside).mean() > 0.999


# 2 ---------------------------------------------------------------------------------------------

def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op2_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_language_edges(spark, odd, empty, docs):
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = langid.identify(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.fit(empty) is None and langid.identify(empty, model).count() == 0


def test_ngrams_are_distinct_byte_grams():
    for text in ["", "a", "ab", "aba", "Abracadabra é"]:
        b = text.lower().encode()
        for n, got in enumerate(langid.ngrams(text), 1):
            want = {int.from_bytes(b[i : i + n], "big") for i in range(len(b) - n + 1)}
            assert sorted(got - langid._OFFSETS[n - 1]) == sorted(want)


def test_kernel_is_the_blended_spectrum_kernel():
    a, b = "abcab", "bcabc"
    model = langid.Classifier(["x", "y"], [langid.ngrams(a), langid.ngrams(b)], [0, 1])
    got = (model.rows([langid.ngrams(a)]) @ model.rows([langid.ngrams(b)]).T)[0, 0]
    grams = lambda s, n: {s[i : i + n] for i in range(len(s) - n + 1)}
    want = np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)])
    assert got == pytest.approx(want)


def test_language_stage_rejects_what_no_language_claims(spark, docs):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(n))
    junk = [words(n) for n in (8, 20, 100, 1000)] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/"), 600))]
    junk += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    planted = spark.createDataFrame([(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], docs.schema)
    labelled = planted.limit(1).withColumns({"doc_id": F.lit(10**9 + 99).cast("long"), "lang": F.lit("en")})  # a wrong label
    for frame in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        want = {r.doc_id for r in frame.collect() if any(c.isalpha() for c in r.text or "")}
        got = {r.doc_id for r in corpus_pipeline.language_id(spark, frame.unionByName(planted).unionByName(labelled), "").collect()}
        assert got == want
        one = frame.where("lang = 'en'")
        want = {r.doc_id for r in one.collect() if any(c.isalpha() for c in r.text or "")}
        assert {r.doc_id for r in corpus_pipeline.language_id(spark, one.unionByName(planted), "").collect()} == want  # one language


# 3 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"only": 1.0}, {str(i): 1 + i for i in range(30)}])
def test_pfair_deviation(weights):
    counts = mixing.shares(weights, 200)
    plan = mixing.schedule(counts)
    assert sum(counts.values()) == 200 and sorted(x[4] for x in plan) == list(range(200))
    done = defaultdict(int)
    for source, j, release, deadline, slot in sorted(plan, key=lambda x: x[4]):
        assert release <= slot < deadline and j == done[source]
        done[source] += 1
        for k, c in counts.items():
            assert abs(done[k] - (slot + 1) * c / 200) < 1


def test_mix_positions_and_deviation(spark, sf, docs):
    got = sorted(mixing.op3_mix_sources(spark, sf).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(docs.count()))
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.doc_id)
        assert r.release <= r.slot < r.deadline
    assert all(x == sorted(x) for x in by.values())


def test_mix_edges(odd, empty):
    got = mixing.mix(odd, {"a": 1.0, None: 2.0, "nowhere": 1.0}, period=10, block_rows=1).collect()
    assert sum(r._copies for r in got) == len(ODD)
    late = [r.position for r in got if r.weight == 0]
    assert min(late) > max(r.position for r in got if r.weight > 0)
    assert mixing.mix(odd, max_sources=1).agg(F.sum("_copies")).first()[0] == len(ODD)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 2, "b": 1}, {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(1, 6), "d": Fraction(1, 6)}, {"a": 1.0, "b": 2**0.5, "c": 1e-4}])
def test_mix_follows_the_true_weights(spark, weights):
    importable(spark)
    total, slots = sum(map(Fraction, weights.values())), 30_000
    share = {k: Fraction(w) / total for k, w in weights.items()}
    table = " union all ".join(f"select id, '{k}' as source from range({int(slots * w) + 2})" for k, w in share.items())
    docs = spark.sql(f"select id + 1000000 * ascii(source) as doc_id, cast(id as string) as text, source from ({table})")
    got = sorted(mixing.mix(docs, weights, block_rows=1).toLocalIterator(), key=lambda r: r.position)
    assert len(got) == docs.count() and all(r.release <= r.slot < r.deadline for r in got)
    assert {r.source: r.weight for r in got} == pytest.approx({k: float(w) for k, w in share.items()}, rel=1e-12)
    done = dict.fromkeys(share, 0)
    for n, r in enumerate(got[:slots], 1):
        done[r.source] += 1
        assert all(abs(done[k] * w.denominator - n * w.numerator) < w.denominator for k, w in share.items())


def test_mix_schedules_every_source(spark, monkeypatch):
    importable(spark)
    docs = spark.sql("select id as doc_id, cast(id as string) as text, concat('site', if(id < 7500, id % 1500, id % 100)) as source from range(9000)")
    for limit in (mixing.BROADCAST_SOURCES, 10):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = sorted(mixing.mix(docs, block_rows=1).collect(), key=lambda r: r.position)
        sizes = defaultdict(int)
        for r in got:
            sizes[r.source] += 1
        assert len(sizes) == 1500 and set(sizes.values()) == {5, 20}
        total, done = sum(n**0.5 for n in sizes.values()), np.zeros(1500)
        share = np.array([n**0.5 / total for n in sizes.values()])
        place = {k: i for i, k in enumerate(sizes)}
        assert all(r.release <= r.slot < r.deadline and r.weight == pytest.approx(share[place[r.source]]) for r in got)
        for n, r in enumerate(got[:5000], 1):
            done[place[r.source]] += 1
            assert abs(done - n * share).max() < 1


# 4 ---------------------------------------------------------------------------------------------

PIECES = ["a  b", "a   b", "  x", "x ", "x  ", " ", "", "foo\n bar", "foo\n\n bar", "foo\n \nbar", "it's  I'll 'S ÀÉ ß İ Σς", "<|endoftext|> hi", "a b", "a\x1cb", "日本 123 4.5!!", "é ́x", "\ttab\t x", "x_y__z --- ..."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, texts):
    path = public_tokenizers.path(name)
    plain, fast = Tokenizer.from_file(path), Encoder(path, limit=50)
    for text in [*PIECES, *list(texts.values())[:60]]:
        assert np.frombuffer(fast.encode(text), U4).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 1000], list(range(0, 10**6, 977)), [2**40, 2**40 + 1], [7] * 1000])
def test_elias_fano_round_trip(values):
    ef = token_store.EliasFano.from_bytes(token_store.EliasFano.of(values).to_bytes())
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    bits = 8 * len(token_store.EliasFano.of(ends).to_bytes()) / len(ends)
    assert bits < 2.3 + np.log2(ends[-1] / len(ends)) < 16


def test_token_store(spark, sf, texts):
    got = sorted(token_store.op4_token_store(spark, sf).collect(), key=lambda r: r.doc_id)
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in got:
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, U4).tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_token_store_edges(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_store.write_store(odd, scratch(spark, "t"), path, shard_ids=20)
    got = token_store.read_store(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ODD)
    assert sorted(r.start for r in got)[0] == 0 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    shard = token_store.Shard(open(manifest.first().file.removeprefix("file://"), "rb").read())
    assert shard.ids(0)[-1] == 0
    with pytest.raises(ValueError):
        token_store.Shard(token_store.shard_bytes([1], [b"\0\0\0\0"], 2)[:-1] + b"?")
    assert token_store.read_store(token_store.write_store(empty, scratch(spark, "t"), path)).count() == 0


# 5 ---------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, sf):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r.page_id: r for r in warc.op5_warc(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        payload, own = html.encode(), first[html] == i
        assert got[i][1:] == (len(payload), warc.digest(payload), "response" if own else "revisit", None if own else first[html])


def test_warc_edges(spark):
    rows = [(3, "u", "x", 1), (2, None, "x", 1), (2, None, "x", 1), (5, "u", None, 1), (4, "u\r\nX: y", "", 1), (None, "u", "x", 1), (6, "u", "é" * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    records, gaps = warc.read_warc(warc.write_warc(pages, scratch(spark, "w")), with_payload=True)
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in records.collect())))
    assert got == sorted(map(str, [(2, 1, "response", None), (2, 1, "response", None), (3, 1, "revisit", 2), (None, 1, "revisit", 2), (4, 0, "response", None), (5, 0, "revisit", 4), (6, 100_000, "response", None)]))
    assert gaps.count() == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch(spark, "w")))[0].count() == 0


def test_warc_long_url_and_strict_read(spark, tmp_path):
    rows = [(1, "http://x/" + "a" * 100_000, "long"), (2, "http://x/" + "é\n" * 100_000, "longer"), (3, "http://x/", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.payload_bytes for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {1: 4, 2: 6, 3: 5}
    (tmp_path / "bad.warc.gz").write_bytes(warc.member(warc.page_record(1, "u", "x", warc.digest(b"x"), None, True)) + b"junk")
    manifest = spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz", 1)], "file string, records long")
    assert warc.read_warc(manifest)[0].count() == 1
    with pytest.raises(Exception, match="unreadable bytes"):
        warc.read_warc(manifest, strict=True)[0].collect()


def test_salvage_recovers_later_records():
    rows = [warc.page_record(i, "http://x/", f"page {i} " * 50, warc.digest((f"page {i} " * 50).encode()), None, True) for i in range(6)]
    for parts in ([warc.member(r) for r in rows], rows):
        for harm in ("flip", "cut", "garbage", "header"):
            bad = bytearray(parts[2])
            if harm == "flip":
                bad[len(bad) // 2] ^= 0xFF
            elif harm == "cut":
                bad = bad[: len(bad) // 2]
            elif harm == "garbage":
                bad = bytearray(b"\x1f\x8bjunk WARC/1.1 \r\n") + bad[40:]
            else:
                bad[0] ^= 1
            data = b"".join([*parts[:2], bytes(bad), *parts[3:]])
            got, gaps = warc.salvage(data)
            assert [r["x-page-id"] for r in got] == ["0", "1", "3", "4", "5"], harm
            start = len(parts[0]) + len(parts[1])
            assert gaps == [(start, start + len(bad))]
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"junk") == ([], [(0, 4)])
    whole = b"".join(warc.member(r) for r in rows)
    assert len(warc.salvage(whole[:-5])[0]) == 5


# 6 ---------------------------------------------------------------------------------------------

def check_shards(rows, got, shards):
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for t in rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
        assert abs(sum(r.size for r in x) - total / shards) <= largest


def test_shards(spark, sf, docs, texts):
    got = sharding.op6_balanced_shards(spark, sf).collect()
    check_shards(texts.values(), got, 16)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    order = [(r.shard, r.slot) for r in sorted(got, key=lambda r: r.doc_id)]
    assert order == sorted(order)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(sharding.ORACLE["op6_balanced_shards"]).df().sort_values("doc_id")
    assert [(r.doc_id, r.size, r.shard, r.slot) for r in sorted(got, key=lambda r: r.doc_id)] == list(want[["doc_id", "size", "shard", "slot"]].itertuples(index=False, name=None))


def test_shard_edges(odd, empty):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ODD)
    assert sharding.shard(empty).count() == 0


# 7 ---------------------------------------------------------------------------------------------

def check_packing(texts, got, window=4096):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], U4)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for x in by_window.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(r.length for r in got) / (len(by_window) * window)


def test_packing(spark, sf, texts):
    assert check_packing(texts, packing.op7_pack(spark, sf).collect()) > 0.95


def test_packing_streams_and_edges(spark, odd, empty, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    some = docs.where("doc_id < 60")
    got = packing.pack(some, path, window=512, segment=2048, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, U4).tobytes()) == r.ids_crc32 for r in got)
    assert check_packing({i: t for i, t in texts.items() if i < 60}, got, 512) > 0.97
    assert sum(r.length for r in packing.pack(odd, path).collect()) > len(ODD)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    spots, fees, window = np.cumsum(rng.integers(1, 20, 60)), rng.integers(0, 9, 60), 50
    at, cost = [0, *spots], [0] + [10**9] * 60
    for j in range(1, 61):
        for i in range(j):
            if at[j] - at[i] <= window:
                cost[j] = min(cost[j], cost[i] + window - (at[j] - at[i]) + fees[j - 1])
    cuts, begin, got = packing.choose_cuts(spots, fees, window), 0, 0
    for c in cuts:
        assert spots[c] - begin <= window
        got, begin = got + window - (spots[c] - begin) + fees[c], spots[c]
    assert got == cost[-1]


# 8 ---------------------------------------------------------------------------------------------

def scan_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hit = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hit
        labels |= {label} if hit else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = licenses.op8_license_scan(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_base > 0 for r in got) > 3
    for r in got:
        assert tuple(r[1:6]) == scan_brute(texts[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_edges(spark, odd, empty):
    mit = next(t for t, l in licenses.NOTICES.items() if l == "mit")
    damaged = mit.replace("any person", "any natural or legal person").replace("charge", "Charge!")
    rows = [(1, f"intro {mit} end"), (2, damaged), (3, "under the MIT license. Under the mit-license under"), (3, "under the MIT license. Under the mit-license under"), (3, None), (None, "cc by nc"), (5, "cc by-nc " * 4000), (6, mit[:30])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (i, t) in zip(sorted(got, key=str), sorted(rows, key=lambda x: str(x))):
        pass
    assert sorted(str((r.doc_id, *r[1:6])) for r in got) == sorted(str((i, *scan_brute(t))) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].labels == by[2].labels == "mit" and by[2].score < 1 == by[1].score and by[6].labels == ""
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------

def test_simhash(spark, sf, texts):
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, sf).collect()}
    assert got.keys() == texts.keys()
    order = sorted(texts, reverse=True)
    same = defaultdict(set)
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same[text].add(r.fingerprint)
        bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 64
        assert r.near_next == 1 - bits(r.fingerprint, got[order[(i + 1) % len(order)]].fingerprint) / 64
        if doc % 100 == 0:
            assert r.n_within == sum(bits(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in got.values())
        else:
            assert r.n_within is None
    assert all(len(x) == 1 for x in same.values())
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def test_simhash_votes(spark):
    text = "a b c d e f g a b c d e x"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = simhash.fingerprints(rows, ["doc_id"], "text").first()
    words = text.split()
    terms = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hashes = spark.createDataFrame(terms, "a string, b string, c string, d string, e string").select(F.xxhash64("a", "b", "c", "d", "e")).collect()
    want = 0
    for i in range(64):
        ones = sum((h[0] >> i) & 1 for h in hashes)
        want |= (2 * ones > len(hashes)) << i
    assert got.fp % (1 << 64) == want


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64)
    fps = set(map(int, base))
    for b in base:
        for _ in range(8):
            x = int(b)
            for bit in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.query_fp, r.fp) for r in simhash.near_tables(df, df).collect()}
    u = lambda x: x % (1 << 64)
    assert got == {(a, b) for a in fps for b in fps if bin(u(a) ^ u(b)).count("1") <= simhash.RADIUS}


def test_simhash_edges(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = simhash.op9_simhash(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(ODD) and all(0 <= r.near_next <= 1 for r in got)
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert simhash.op9_simhash(spark, f"{tmp_path}/b").count() == 0
    odd.limit(1).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert [r.near_next for r in simhash.op9_simhash(spark, f"{tmp_path}/c").collect()] == [1.0]


# 10 --------------------------------------------------------------------------------------------

def groups_brute(texts, k):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, sf, texts):
    got = minhash.op10_near_duplicates(spark, sf).collect()
    want = groups_brute(texts, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_chains(spark):
    """Links between a bucket's classes that aren't linked with its smallest one."""
    rng = np.random.default_rng(5)
    words, rows = [f"w{i}" for i in range(4000)], {}
    for g in range(6):
        w = list(rng.choice(words, 120))
        for step in range(14):
            rows[g * 100 + step] = " ".join(w)
            for at in rng.choice(len(w), 3, replace=False):
                w[at] = str(rng.choice(words))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == groups_brute(rows, 4)


def test_near_duplicate_edges(spark, odd, empty):
    got = minhash.near_duplicates(odd, 5).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2)] == [(0, 1), (0, 2)] or {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 2}
    assert minhash.near_duplicates(empty, 5).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in minhash.components(frame).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
    assert got == {r.node: r.root for r in minhash.components(frame, task_edges=50).collect()}


def test_odd_sketch_estimates():
    for share in (1.0, 0.95, 0.9, 0.8):
        shift = int(1000 * (1 - share) / (1 + share))
        sets = [minhash.mixed(np.arange(i, i + 1000, dtype=np.uint64) + np.uint64(1)) for i in (0, shift)]
        s = minhash.odd_sketches(np.array([minhash.min_hashes(x) for x in sets]))
        differing = bin(int.from_bytes((s[0] ^ s[1]).tobytes(), "little")).count("1")
        assert abs(minhash.estimate(differing) - share) < 0.13 and differing <= minhash.SKETCH_LIMIT


# pipeline --------------------------------------------------------------------------------------

def test_pipeline(spark, sf, docs, texts):
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = scratch(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["language_id"]} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    want = {i for i, (_, root) in groups_brute({r.doc_id: r.text for r in kept["language_id"]}, 5).items() if i == root}
    assert {r.doc_id for r in kept["near_dedup"]} == want == {r.doc_id for r in kept["mix_sources"]}
    assert kept["mix_sources"][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert check_packing({i: texts[i] for i in want}, pieces) > 0.9
    mixed = [r.doc_id for r in sorted(mixing.mix(spark.createDataFrame(kept["near_dedup"])).collect(), key=lambda r: r.position)]
    assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0] == mixed


def test_pipeline_edges(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            path = scratch(spark, name)
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (df is odd)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][1] == "near_dedup"
    assert pa.__version__
