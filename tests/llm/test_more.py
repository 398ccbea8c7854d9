"""Whole results against plain versions, hot groups, ties and clashing names."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_llm import LONG, ODD, groups_brute
from veritab.llm import ann, langid, licenses, minhash, mixing, packing, sharding, token_store, warc
from veritab.llm._common import importable, scratch

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    importable(spark)
    return spark.createDataFrame(ODD, DDL).cache()


# 1 ---------------------------------------------------------------------------------------------

def test_probed_cells_keep_the_recall(spark):
    """Many cells, of which a query probes some: recall against brute force, over clustered vectors."""
    importable(spark)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 24))
    v = (centres[rng.integers(0, 40, 12_000)] + 0.4 * rng.standard_normal((12_000, 24))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    got = ann.search(df, F.col("vec_id") % 200 == 0, k=10).toPandas()
    recall = []
    for q, g in got.groupby("query_id"):
        scores = v.astype(float) @ v[q].astype(float)
        scores[q] = -np.inf
        want = np.argsort(-scores)[:10]
        recall.append(len(set(want) & set(g.vec_id)) / 10)
        assert np.allclose(g.sort_values("rank").score, scores[g.sort_values("rank").vec_id])
    assert len(recall) == 60 and np.mean(recall) >= 0.95
    model = ann.Model(v[:8000], 12, k=10)
    assert len(model.centres) == 12 and 1 <= model.probes < 12


def test_scores_on_double_vectors(spark):
    importable(spark)
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(40)] + [(40, [1e300, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(40, 1e300), (39, 2.0 + 39 * 1e-12), (38, 2.0 + 38 * 1e-12)]


# 2 ---------------------------------------------------------------------------------------------

def plain_scores(texts, labels, landmarks, asked, ridge):
    """The classifier by sets of n-grams, a kernel of loops and least squares."""
    def grams(t, n):
        b = t.lower().encode()
        return {b[i : i + n] for i in range(len(b) - n + 1)}

    def kernel(a, b):
        return sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in ((grams(a, n), grams(b, n)) for n in (1, 2, 3)) if x and y) / 3

    marks = [texts[i] for i in landmarks]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = lambda ts: np.hstack([np.array([[kernel(t, m) for m in marks] for t in ts]) @ root, np.ones((len(ts), 1))])
    z, names = features(texts), sorted(set(labels))
    out = []
    for name in names:  # one against the rest
        penalty = np.sqrt(ridge * len(texts)) * np.eye(z.shape[1])
        penalty[-1, -1] = np.sqrt(1e-9)
        w = np.linalg.lstsq(np.vstack([z, penalty]), np.concatenate([np.where(np.array(labels) == name, 1.0, -1.0), np.zeros(z.shape[1])]), rcond=None)[0]
        out.append(features(asked) @ w)
    return names, np.array(out).T


def test_classifier_against_a_plain_one(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) between 40 and 3000").orderBy("doc_id").collect()]
    train, asked = rows[:36], [r.text for r in rows[36:60]]
    texts, labels = [r.text for r in train], [r.lang for r in train]
    landmarks = list(range(0, 36, 3))
    model = langid.Classifier(labels, [langid.ngrams(t) for t in texts], landmarks)
    names, want = plain_scores(texts, labels, landmarks, asked, langid.RIDGE)
    pred, score, _ = model.predict(asked)
    assert model.languages == names and len(names) > 1
    assert pred == [names[i] for i in want.argmax(1)]
    assert score == pytest.approx(np.clip((want.max(1) + 1) / 2, 0, 1), abs=2e-3)


def test_learning_takes_one_of_repeated_rows(spark):
    importable(spark)
    rows = [(1, "the river is wide and old", "en")] * 500 + [(1, "another text of that number", "en"), (2, "der fluss ist breit und alt", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and model.predict(["the old river", None]) [0] == ["en", "und"]


# 3 ---------------------------------------------------------------------------------------------

def test_mix_whole_table_against_a_plain_schedule(spark, sf):
    """Every row's block, window, slot and place, by trying all sources for every slot."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    rows = defaultdict(list)
    for r in sorted(docs, key=lambda r: r.doc_id):
        rows[r.source].append(r.doc_id)
    weight = {s: Fraction(len(x) ** 0.5) for s, x in rows.items()}
    total = sum(weight.values())
    share = {s: w / total for s, w in weight.items()}
    blocks = {s: [x[i : i + mixing.BLOCK_ROWS] for i in range(0, len(x), mixing.BLOCK_ROWS)] for s, x in rows.items()}
    done, slot, place, want = dict.fromkeys(rows, 0), 0, 0, {}
    while any(done[s] < len(blocks[s]) for s in rows):
        open_ = []
        for s in rows:
            j = done[s]
            if j < len(blocks[s]) and int(j / share[s]) <= slot:
                open_.append((-int(-(j + 1) // share[s]), f"s{s}" if s is not None else "n", s))
        if open_:
            due, _, s = min(open_)
            j = done[s]
            for doc in blocks[s][j]:
                want[doc] = (s, j, int(j / share[s]), due, slot, place)
                place += 1
            done[s] += 1
        slot += 1
    got = mixing.op3_mix_sources(spark, sf).collect()
    assert {r.doc_id: (r.source, r.block, r.release, r.deadline, r.slot, r.position) for r in got} == want
    assert all(r.weight == pytest.approx(float(share[r.source]), abs=1e-12) for r in got)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mix_equals_its_sql(spark, scale):
    importable(spark)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{scale}/documents.parquet'")
    rel = con.execute(mixing.ORACLE["op3_mix_sources"])
    columns = [c[0] for c in rel.description]
    got = mixing.op3_mix_sources(spark, f"/root/testdata/{scale}").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    """The schedule's length is bounded, and every row still has its place."""
    importable(spark)
    docs = spark.sql("select id as doc_id, cast(id as string) as text, if(id % 3 = 0, 'a', 'b') as source from range(3000)")
    monkeypatch.setattr(mixing, "BLOCKS", 30)
    got = sorted(mixing.mix(docs).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(3000)) and 30 <= len({r.slot for r in got}) <= 32
    assert all(r.release <= r.slot < r.deadline for r in got)


# 4 and 7 ---------------------------------------------------------------------------------------

def test_rows_of_one_id_have_one_order(spark):
    """A hot doc_id: its rows are split by their text, lie in the order of the texts' hashes, and two runs agree."""
    importable(spark)
    texts = [f"text number {i % 37}" for i in range(400)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(None, "n"), (8, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = []
    for frame in (df, df.orderBy(F.rand(3)).repartition(5)):
        manifest = token_store.write_store(frame, scratch(spark, "tied"), path)
        assert manifest.count() > 1
        runs.append(sorted(tuple(r) for r in token_store.read_store(manifest).collect() if r.doc_id == 7))
    plain = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    hashed = sorted((r.h, r.text) for r in df.where("doc_id = 7").select("text", F.xxhash64("text").alias("h")).collect())
    assert runs[0] == runs[1] and [r[3] for r in sorted(runs[0], key=lambda r: r[1])] == [crc(t) for _, t in hashed]
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), window=64)
    assert Counter(r.doc_id for r in pieces.collect() if r.start == 0) == {7: 400, None: 1, 8: 1}


def test_packing_edges_row_by_row(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    sizes = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ODD)
    got = packing.pack(odd, path).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == sizes
    total = defaultdict(int)
    for r in got:
        assert 0 < r.length <= 4096
        total[r.doc_id] += r.length
    want = defaultdict(int)
    for (i, n), times in sizes.items():
        want[i] += n * times
    assert total == want


# 5 ---------------------------------------------------------------------------------------------

def test_records_of_one_page_have_ids_of_their_own(spark, tmp_path):
    importable(spark)
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "u", "other"), (2, "u", "same"), (None, "u", "same"), (None, "u", "alone")]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    found = [r for f in manifest.collect() for r in warc.salvage(open(f.file.removeprefix("file://"), "rb").read())[0]]
    ids = [r["warc-record-id"] for r in found]
    assert len(set(ids)) == len(rows)
    revisits = [r for r in found if r["warc-type"] == "revisit"]
    assert sorted(r["x-page-id"] for r in revisits) == ["2", "null"]
    assert all(r["warc-refers-to"] in {x["warc-record-id"] for x in found if x["warc-type"] == "response"} for r in revisits)


def test_members_of_several_records():
    rows = [warc.page_record(i, "http://x/", f"page {i}", warc.digest(f"page {i}".encode()), None, True) for i in range(5)]
    found, gaps = warc.salvage(warc.member(b"".join(rows)))
    assert [r["x-page-id"] for r in found] == list("01234") and gaps == []
    bad = warc.member(b"".join([rows[0], rows[1][:-40], rows[2]]))
    found, gaps = warc.salvage(bad + warc.member(rows[3]))
    assert [r["x-page-id"] for r in found] == ["0", "2", "3"] and gaps == [(0, len(bad))]


# 6 and 8 ---------------------------------------------------------------------------------------

def test_shard_edges_row_by_row(odd):
    got = sharding.shard(odd, 3).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in got) == sorted(((i or -1), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= {0, 1, 2} and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_license_families_are_told_apart(spark):
    texts = {
        "gpl": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "lgpl": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "agpl": "under the terms of the GNU Affero General Public License, version 3",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc-by-sa": "under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "cc-by-nc": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "": "a general public license for creative work and attribution of software in the commons",
    }
    got = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == list(texts)
    for n, (text, label) in enumerate(licenses.NOTICES.items()):
        assert licenses.scan(spark.createDataFrame([(n, f"x {text} y")], "doc_id long, text string")).first().labels == label


# 10 --------------------------------------------------------------------------------------------

def test_hot_group_of_near_copies(spark):
    """Copies of one text, edited apart until many are no longer alike: every link is kept."""
    importable(spark)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    stem, rows = list(rng.choice(words, 150)), {}
    for i in range(260):
        w = list(stem)
        for at in rng.choice(150, rng.integers(0, 12), replace=False):
            w[at] = str(rng.choice(words))
        rows[i] = " ".join(w)
    rows |= {1000 + i: rows[i % 3] for i in range(300)}  # exact copies
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 4).collect()}
    want = groups_brute(rows, 4)
    assert got == want and len({root for _, root in want.values()}) > 10


def test_repeated_rows_of_one_id(spark):
    """A third of all rows are one row, and an id stands for several texts."""
    importable(spark)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 300 + [(1, "another text of that number, not alike")] + [(2, text + " and more")] + [(i, f"document {i} is unlike all the other {i * 7} ones") for i in range(3, 500)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.component_id) for r in got if r.doc_id < 3) == {(1, 1): 301, (2, 1): 1}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id > 2)


def test_full_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 100, 800):
        x = minhash.mixed(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            y = np.unique(np.concatenate([x[int(n * share) :], minhash.mixed(rng.integers(0, 1 << 62, int(n * share)).astype(np.uint64))]))
            differing = sum(bin(int(a) & (1 << 64) - 1).count("1") for a in minhash.full_sketch(x) ^ minhash.full_sketch(y))
            assert differing <= len(np.setxor1d(x, y))
    assert minhash.full_sketch(np.arange(minhash.FULL + 1, dtype=np.uint64)) is None


def test_sketches_decide_near_the_threshold():
    """At 0.8 no pair of 300 is dropped, at 0.6 nearly every one is."""
    rng = np.random.default_rng(2)
    kept = {}
    for share in (0.8, 0.6):
        shift, kept[share] = round(2000 * (1 - share) / (1 + share)), 0
        for _ in range(300 if share == 0.8 else 60):
            every = minhash.mixed(rng.integers(0, 1 << 62, 2000 + shift).astype(np.uint64))
            s = minhash.odd_sketches(np.array([minhash.min_hashes(every[:2000]), minhash.min_hashes(every[shift:])]))
            kept[share] += sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1]) <= minhash.SKETCH_LIMIT
    assert kept[0.8] == 300 and kept[0.6] <= 1


# pipeline --------------------------------------------------------------------------------------

CLASHES = ["score", "lang_pred", "claimed", "_id", "_hash", "_position", "id", "no_id", "hash", "turn", "place", "from", "own_hash", "a.b"]


def test_stages_keep_columns_of_any_name(spark, sf):
    """Extra columns by the names that stages, operators or older versions use come out as they went in."""
    importable(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = scratch(spark, name)
        stage(spark, wide, sf).write.parquet(path)
        wide = spark.read.parquet(path)
        assert wide.columns == [*docs.columns, *CLASHES]
        assert all(r[c] == f"{c}-{r.doc_id}" for r in wide.collect() for c in CLASHES), name
        plain = scratch(spark, name)
        stage(spark, docs, sf).write.parquet(plain)
        docs = spark.read.parquet(plain)
        assert [r.doc_id for r in docs.collect()] == [r.doc_id for r in wide.collect()] or sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in wide.collect())


def test_stages_on_odd_rows(spark, odd):
    """What each stage makes of nulls, empty and long texts, ties and repeated rows."""
    kept = corpus_pipeline.language_id(spark, odd, "")
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, t, *_ in ODD if t and any(c.isalpha() for c in t))
    ties = spark.createDataFrame([(3, "a b c d e f g", "en", "x"), (3, "a b c d e f g", "en", "w"), (3, "A b c d e f g", "en", "x"), (4, "a b c d e f g", "de", "x"), (9, None, None, None), (9, None, None, None), (None, "a b c d e f g", "en", "x"), (None, "unlike all the others here and there", "en", "x")], "doc_id long, text string, lang string, source string")
    runs = [sorted(map(str, corpus_pipeline.near_dedup(spark, df, "").collect())) for df in (ties, ties.orderBy(F.desc("source")).repartition(3))]
    assert runs[0] == runs[1] and len(runs[0]) == 3 and sum("doc_id=3" in r for r in runs[0]) == 1 and sum("doc_id=9" in r for r in runs[0]) == 1
    mixed = corpus_pipeline.mix_sources(spark, odd, "").collect()
    assert sorted(map(str, mixed)) == sorted(map(str, odd.collect())) and LONG in {r.text for r in mixed}
