"""MinHash near-duplicates with odd sketches.

A document's set holds the hashes of its distinct word k-grams (A-Z lower-cased, words between
ASCII white space; fewer words: the whole sequence; none: empty, linked with nothing). Documents
with equal sets form a class. 128 min-hashes of a class fall into 32 bands of 4: two sets with a
similarity of 0.8 share no band with a probability under 1e-7. 512 min-hashes, those among them, are
folded into an odd sketch, a 2048-bit parity bitmap; the bits in which two sketches differ tell how
many min-hashes differ. A pair is dropped where they are more than five standard deviations over
what the least similarity makes them (a probability under 1e-6 at 0.8; at 0.7 nearly all go). Sets
of up to FULL shingles have a second odd sketch, into which every shingle is folded: its differing
bits never outnumber the differing shingles, so it drops pairs by an exact bound, sharp to one or
two hundredths. What is left is confirmed on the full sets.

No bucket is turned into all of its pairs. Each class is first compared with its buckets' hub, the
class that meets most others over all of its buckets: in a group of copies that were edited apart,
the text that they stem from. Components of the confirmed links follow. A bucket whose classes all
lie in one component is done. In the others every class outside the bucket's main component meets
one of that component, a few times over, and what is then still apart is compared, sketch by sketch
inside the join, with the classes of other components, so that no link between components is lost,
whatever the bucket's size. Only pairs that both sketches leave come out of that join.
Buckets, pairs and components stay distributed; skewed joins are split at run time.

Defined results: null and word-less texts have n_shingles 0 and a component of their own; a null
doc_id is never smaller than another, and alone gives a null component_id, kept; rows that share a
doc_id are linked by their own texts and each gets a row; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpoint, partitions, table

BANDED, BANDS = 128, 32
PERMUTATIONS = 512
SKETCH_WORDS = 32  # of 64 bits
SHARE = 80  # least similarity in hundredths
DEVIATIONS = 5  # of the differing bits at the least similarity, allowed for beyond their mean
FULL, FULL_WORDS = 1024, 16
TURNS = 2
TASK_EDGES = 500_000
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the text's distinct word k-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width, windows = min(n, k), max(n - k + 1, 1)
    acc = h[:windows].copy()
    for j in range(1, width):
        acc *= _P
        acc += h[j : j + windows]
    return np.unique(mixed(acc + np.uint64(width)))


def min_hashes(x: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    factors = (np.random.default_rng(7).integers(0, 1 << 31, count, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (low[i : i + 256, None] * factors + high[i : i + 256, None]).min(0), out=out)
    return out


def band_keys(m: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row of min-hashes."""
    rows = m.astype(np.uint64).reshape(len(m), bands, -1)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _P, rows.shape[:2]).copy()
    for j in range(rows.shape[2]):
        acc = mixed(acc * _P + rows[:, :, j])
    return acc.view(np.int64)


def odd_sketches(m: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bitmaps of the rows' (index, min-hash) pairs, as signed 64-bit words."""
    bits = words * 64
    index = np.arange(m.shape[1], dtype=np.uint64) << np.uint64(32)
    spots = (mixed((m.astype(np.uint64) | index) + _P) % np.uint64(bits)).astype(np.int64)
    flat = (spots + np.arange(len(m))[:, None] * bits).ravel()
    odd = (np.bincount(flat, minlength=len(m) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(m), words)


def full_sketch(x: np.ndarray, words: int = FULL_WORDS) -> np.ndarray | None:
    """The odd sketch of a whole set; None for one of more than FULL shingles."""
    if len(x) > FULL:
        return None
    odd = np.bincount((x & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch_limit(share: int = SHARE, count: int = PERMUTATIONS, bits: int = SKETCH_WORDS * 64) -> int:
    """The most differing bits that a pair of the similarity may be taken to have: each of some
    count * (1 - similarity) differing min-hashes, a binomial number, flips two bits at random."""
    s = share / 100
    kept = (1 - 2 / bits) ** (2 * count * (1 - s))  # 1 less twice the chance that a bit differs
    by_samples = bits * -np.log1p(-2 / bits) * kept * np.sqrt(count * s * (1 - s))
    by_folding = np.sqrt(bits * (1 - kept**2) / 4)
    return int(bits / 2 * (1 - kept) + DEVIATIONS * np.hypot(by_samples, by_folding)) + 1


SKETCH_LIMIT = sketch_limit()


def estimate(differing: int, count: int = PERMUTATIONS, bits: int = SKETCH_WORDS * 64) -> float:
    """The similarity that so many differing sketch bits stand for."""
    return 1 + bits / (4 * count) * np.log(max(1 - 2 * differing / bits, 1e-9))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, bands, sketch, whole): key stands for the set, 16 bytes;
    whole: its full sketch or null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary())] + [(c, pa.list_(pa.int64())) for c in ("bands", "sketch", "whole")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, keys, mins, wholes = [], [], [], []
                for text in batch.column(1):
                    x = shingle_set(text.as_py(), k)
                    counts.append(len(x))
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    mins.append(min_hashes(x))
                    wholes.append(full_sketch(x))
                m = np.array(mins)
                lists = [pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel())) for v in (band_keys(m[:, :BANDED]), odd_sketches(m))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), *lists, pa.array(wholes, pa.list_(pa.int64()))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, sketch array<long>, whole array<long>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) from (cid, key, text), of the texts whose set the key stands for; of repeated
    rows in a task, one."""
    schema = pa.schema([("cid", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                cids, sets = [], []
                for cid, key, text in zip(*whole.slice(at, 256).columns):
                    if cid.as_py() in seen:
                        continue
                    x = shingle_set(text.as_py(), k)
                    if xxhash.xxh3_128_digest(x.tobytes()) == key.as_py():
                        seen.add(cid.as_py())
                        cids.append(cid.as_py())
                        sets.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return texts.select("cid", "key", "text").mapInArrow(run, "cid long, shingles array<long>")


def _forest(batches):
    """Of the edges (u, v) of a task, each node with the smallest node that it is joined to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    pairs = [(x, find(x)) for x in root]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b) but the roots: the smallest node of each
    component. Tasks of some task_edges edges first contract what they hold to stars; what spans
    several tasks is joined by alternating large and small stars, each round checkpointed."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = 1 + e.count() // task_edges
    e, seen = checkpoint(e.repartition(tasks).mapInArrow(_forest, "u long, v long").distinct()), None
    while tasks > 1:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        pairs = both(e)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _differing(a: str, b: str, words: int):
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)])


def hopeful(a: str, b: str, share: int = SHARE):
    """Whether the sketches of two classes leave the similarity possible; a, b: prefixes of their
    columns n, sketch and whole. Sizes and full sketches are exact bounds."""
    n, m = F.col(a + "n"), F.col(b + "n")
    sizes = 100 * F.least(n, m) >= share * F.greatest(n, m)
    exact = (100 + share) * _differing(a + "whole", b + "whole", FULL_WORDS) <= (100 - share) * (n + m)
    return sizes & F.coalesce(exact, F.lit(True)) & (_differing(a + "sketch", b + "sketch", SKETCH_WORDS) <= sketch_limit(share))


def confirm(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (cid, shingles) have the similarity."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return counted.where(100 * F.col("i") >= share * (F.col("n") - F.col("i"))).select("a", "b")


def crossing_pairs(rest: DataFrame, sketches: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs (a, b) in one bucket but different components that the sketches leave possible."""
    x = checkpoint(rest.join(sketches, "cid"))
    l, r = x.where("root <> main").alias("l"), x.alias("r")
    crossing = (
        (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.root") != F.col("r.root"))
        & ((F.col("r.root") == F.col("r.main")) | (F.col("l.cid") < F.col("r.cid"))) & hopeful("l.", "r.", share)
    )
    return l.join(r, crossing).select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, share: int = SHARE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, root, component_id, kept) for every row; root: the component's number."""
    signed = checkpoint(signatures(docs, k))
    classes = signed.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sketch", "whole")], F.first("n_shingles").alias("n")
    )
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))
    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(buckets.join(shared, "bucket"))
    met = met.join(met.groupBy("cid").agg(F.sum("n").alias("meets")), "cid")
    pivots = met.groupBy("bucket").agg(F.max_by("cid", F.struct("meets", -F.col("cid"))).alias("pivot"))
    members = checkpoint(met.select("bucket", "cid").join(pivots, "bucket"))
    sketches = classes.select("cid", "n", "sketch", "whole")

    def sketched(pairs: DataFrame) -> DataFrame:
        of = lambda side: sketches.select(*[F.col(c).alias(f"{side}_{c}" if c != "cid" else side) for c in sketches.columns])
        return pairs.join(of("b"), "b").join(of("a"), "a").where(hopeful("a_", "b_", share)).select("a", "b")

    near = members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    near = checkpoint(sketched(near))

    # the full sets of all classes that share a bucket, dealt by class: joins to them don't move them
    wanted = members.select("cid").distinct().join(classes.select("cid", "key", "rep"), "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "key", "text")
    sets = checkpoint(shingle_sets(texts, k).repartition(partitions(docs.sparkSession), "cid"))

    def opened(roots: DataFrame) -> DataFrame:
        """(bucket, cid, root, main) of the buckets whose classes other than the pivot, which met
        them all, lie in several components."""
        x = members.where("cid <> pivot").select("bucket", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        x = x.withColumn("root", F.coalesce("root", "cid"))
        sizes = x.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        mains = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
        return checkpoint(x.join(mains.where("roots > 1").drop("roots"), "bucket"))

    links = checkpoint(confirm(near, sets, share))
    roots = components(links)
    rest = opened(roots)
    for turn in range(TURNS):  # a class outside its bucket's main component meets one class of it
        first = Window.partitionBy("bucket").orderBy(F.xxhash64("cid", F.lit(turn)), "cid")
        mates = rest.where("root = main").withColumn("n", F.row_number().over(first)).where("n = 1").select("bucket", F.col("cid").alias("mate"))
        pairs = rest.where("root <> main").join(mates, "bucket").select(F.least("cid", "mate").alias("a"), F.greatest("cid", "mate").alias("b")).distinct()
        pairs = checkpoint(sketched(pairs))
        more = checkpoint(confirm(pairs, sets, share))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = components(links)
        rest = opened(roots)
    if not rest.isEmpty():
        late = checkpoint(crossing_pairs(rest, sketches, share))
        more = checkpoint(confirm(late, sets, share))
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    rooted = classes.select("cid", "key", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "root", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "key").join(named, "key", "left")
    alone = F.col("n_shingles") == 0
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = {
    "op10_near_duplicates": r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from w),
c as (select g, min(doc_id) as rep, len(g) as n from (select doc_id, list_sort(g) as g from g) where len(g) > 0 group by g),
e as (select rep, n, unnest(g) as s from c),
i as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as shared from e a join e b on a.s = b.s and a.rep < b.rep and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by all),
l as (select a, b from i where 100 * shared >= 80 * (na + nb - shared)),
reach(x, y) as (select a, b from l union select b, a from l union select r.x, k.y from reach r join (select a as x, b as y from l union select b, a from l) k on k.x = r.y),
root as (select x, least(x, min(y)) as r from reach group by x)
select g.doc_id, len(g.g) as n_shingles, case when len(g.g) = 0 then g.doc_id else coalesce(root.r, c.rep) end as component_id,
    g.doc_id = case when len(g.g) = 0 then g.doc_id else coalesce(root.r, c.rep) end as kept
from g left join c on c.g = list_sort(g.g) left join root on root.x = c.rep
"""
}
QUERIES = {"op10_near_duplicates": op10_near_duplicates}
