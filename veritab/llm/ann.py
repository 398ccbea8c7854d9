"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector belongs to the cell of its nearest centroid; its residual, padded with zeros to a
multiple of its length of at least CODE_BITS, is rotated at random and only the signs are kept,
packed, with two correction scalars: the residual's norm and the inner product of the unit residual
with its own code. For any query the scalars and the signs give an unbiased estimate of the inner
product and an error bound of the order of 1 / sqrt(bits), and so an upper bound. Vectors whose
upper bound reaches the query's floor are reranked with the original vectors in double precision.

Centroids and rotation are fitted on at most FIT_FLOATS numbers of vectors (those with the smallest
hashes); every vector is indexed. The same sample gives each query its floor, a lower bound of its
k-th best score with SPARE ranks to spare, and tells how many cells have to be probed: the fewest,
nearest first, that hold RECALL of the neighbours which sampled vectors have in the sample. A query
goes to that many cells, without those whose centre and radius rule them out, and to the cells of
its best sampled vectors, so no query is left with less than k candidates. Cells are cut into blocks of BLOCK rows and
the queries of a cell into chunks of CHUNK, so a row of the index moves once for every CHUNK queries
that probe its cell, and each block meets each chunk in a task of its own. Equal vectors are one
candidate with their k + 1 smallest ids, so a vector shared by a third of all rows is scored once.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, as
queries or candidates; vectors of another length than the query's are no candidates of it; a null id
takes no part; components of any finite size are right; rows that repeat an id are one candidate with the better score; a single vector has
no neighbours and no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpoint, table

K = 20
FIT_FLOATS = 1 << 20
MODELS = 64  # of the most frequent lengths; vectors of others are one cell, scanned whole
CELL_ROWS, MAX_CELLS = 1024, 1024
BLOCK, CHUNK = 16_384, 8_192
CODE_BITS = 256
ERROR = 3.5  # standard deviations of the estimate that the bound allows for
RECALL, SPARE = 0.97, 4
LARGE = 1e15  # vectors with components beyond aren't coded: always candidates, and queries of all cells
_BATCH, _PAIRS = 256, 1 << 18


def _rotation(d: int, bits: int) -> np.ndarray:
    """d columns of a random orthogonal matrix with as many rows as a code has bits."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :d], np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += v[:, j].astype(np.float64) * q[:, j].astype(np.float64)
    return out


def _large(v: np.ndarray) -> np.ndarray:
    return np.abs(v).max(axis=1, initial=0) > LARGE


class Model:
    """Sample, centroids, rotation and number of probes for one length of vectors. Codes have the
    least multiple of that length that is at least min_bits."""

    def __init__(self, sample: np.ndarray, cells: int, rounds: int = 8, k: int = K, min_bits: int = 1):
        sample = sample[~_large(sample)]
        sample = sample if len(sample) else np.zeros((1, sample.shape[1]), sample.dtype)
        self.d, self.sample, self.k = sample.shape[1], sample, k
        self.rotation = _rotation(self.d, self.d * -(-min_bits // self.d))
        centres = sample[: max(1, min(cells, len(sample)))].copy()
        for _ in range(rounds if len(centres) > 1 else 0):
            near = self._near(sample, centres)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = sample[near == c].mean(0)
        self.centres, self.homes = centres, self._near(sample, centres)
        self.probes = self._calibrated() if len(centres) > 1 else 1

    @staticmethod
    def _near(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * v @ centres.T).argmin(1)

    def _calibrated(self, recall: float = RECALL, queries: int = 512) -> int:
        """How many cells, by centre, hold the share of the neighbours in the sample."""
        q = self.sample[-queries:]
        own = np.arange(len(self.sample) - len(q), len(self.sample))
        scores = q @ self.sample.T
        scores[np.arange(len(q)), own] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.centres.T), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(self.centres))[None], axis=1)
        found = np.take_along_axis(rank, self.homes[best], axis=1)
        return int(np.quantile(found, recall, method="higher")) + 1

    def encode(self, v: np.ndarray):
        """(cell, code, norm, correction) of each vector; the norm of large ones is infinite."""
        large = _large(v)
        v = np.where(large[:, None], 0, v)
        cell = self._near(v, self.centres)
        rest = (v - self.centres[cell]) @ self.rotation.T
        norm = np.linalg.norm(rest, axis=1)
        code = np.packbits(rest > 0, axis=1)
        own = np.abs(rest).sum(1) / np.sqrt(rest.shape[1]) / np.maximum(norm, 1e-30)
        return cell, code, np.where(large, np.inf, norm), np.where(norm > 0, own, 1.0).astype(np.float32)

    def route(self, q: np.ndarray, radius: np.ndarray):
        """The floors of the queries, and which cells (columns) each has to look into; radius: of
        the cells, -1 of empty ones."""
        large = _large(q)
        q = np.where(large[:, None], 0, q)
        size = np.linalg.norm(q, axis=1)
        floor = np.full(len(q), -np.inf)
        near = q @ self.centres.T
        last = -np.partition(-near, self.probes - 1, axis=1)[:, self.probes - 1]
        into = near >= last[:, None]
        best = self.k + 1 + SPARE  # the query may be in the sample
        if len(self.sample) > best:
            scores = q @ self.sample.T
            top = np.argpartition(-scores, best - 1, axis=1)[:, :best]
            floor = np.take_along_axis(scores, top, axis=1).min(1).astype(np.float64)
            floor -= 1e-4 * size * np.linalg.norm(self.sample, axis=1).max()
            np.put_along_axis(into, self.homes[top], True, axis=1)
        slack = 1e-4 * size[:, None] * np.linalg.norm(self.centres, axis=1)
        reach = near + size[:, None] * radius * 1.0001 + slack >= floor[:, None]
        floor[large] = -np.inf
        return floor, ((into & reach) | large[:, None] | np.isinf(radius)) & (radius >= 0)

    def linear(self, code: np.ndarray, norm: np.ndarray, own: np.ndarray, centre: np.ndarray):
        """Rows whose inner products with turned() queries are the estimates, without the centre's
        share and over the query's norm; and how far off these may be."""
        bits, large = self.rotation.shape[0], np.isinf(norm)
        norm = np.where(large, 0, norm)
        signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
        signs *= (norm / own / np.sqrt(bits))[:, None]
        spread = norm * np.sqrt(np.maximum(1 / own**2 - 1, 0)) / np.sqrt(max(bits - 1, 1))
        return signs, np.where(large, np.inf, ERROR * spread + 1e-4 * (norm + np.linalg.norm(centre)))

    def turned(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1)[:, None]
        return (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32) @ self.rotation.T

    def bounds(self, code: np.ndarray, norm: np.ndarray, own: np.ndarray, centre: np.ndarray, q: np.ndarray):
        """Estimates of the inner products of coded vectors (rows) and queries (columns), and how
        far off they may be."""
        rows, off = self.linear(code, norm, own, centre)
        size = np.linalg.norm(q, axis=1)
        return rows @ self.turned(q).T * size + q @ centre, off[:, None] * size


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, k: int, kind: str) -> DataFrame:
    """(vec, d, h, ids): each distinct vector with its k + 1 smallest ids."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    v = v.where(F.col("id").isNotNull() & valid(F.col("vec"))).withColumn("h", F.xxhash64("vec"))
    first = Window.partitionBy("h", "vec").orderBy("id")
    v = v.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)  # pruned before it is dealt
    return v.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("d", F.size("vec"))


def _by_length(batch: pa.RecordBatch):
    """(d, rows) of the lengths in a batch."""
    dims = batch.column("d").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _best(rows: np.ndarray, cols: np.ndarray, v: np.ndarray, q: np.ndarray, least: np.ndarray, floor: np.ndarray, keep: int):
    """Of candidate pairs (rows of v, columns of q) the best of each column as (row, column, score):
    single precision first, then double for what may be among the best."""
    scores = np.empty(len(rows))
    for at in range(0, len(rows), _PAIRS):
        part = slice(at, at + _PAIRS)
        with np.errstate(over="ignore", invalid="ignore"):
            scores[part] = np.nan_to_num(np.einsum("ij,ij->i", v[rows[part]], q[cols[part]]), nan=np.inf, posinf=np.inf, neginf=-np.inf)
    with np.errstate(over="ignore"):
        slack = 1e-5 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    near = scores >= (floor - slack)[cols]
    rows, cols, scores = rows[near], cols[near], scores[near]
    for precise in (False, True):
        if precise:
            scores = _exact(v[rows], q[cols])
        order = np.lexsort((least[rows], -scores, cols))
        rows, cols, scores = rows[order], cols[order], scores[order]
        starts = np.searchsorted(cols, np.arange(len(q)))
        at = np.minimum(starts + keep - 1, len(cols) - 1)  # the place of a column's keep-th best
        full = cols[at] == np.arange(len(q)) if len(cols) else np.zeros(len(q), bool)
        if precise:
            near = np.arange(len(cols)) - starts[cols] < keep
        else:
            full &= np.isfinite(slack)
            lowest = np.where(full, (scores[at] if len(cols) else 0) - np.where(full, 2 * slack, 0), -np.inf)
            near = scores >= lowest[cols]
        rows, cols, scores = rows[near], cols[near], scores[near]
    return rows, cols, scores


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product for each query.

    is_query: a condition on the id column."""
    spark = vectors.sparkSession
    wide = vectors.schema[vec_col].dataType.simpleString() == "array<double>"
    kind, number = ("array<double>", pa.float64()) if wide else ("array<float>", pa.float32())
    classes = checkpoint(classes_of(vectors, id_col, vec_col, k, kind))
    asks = vectors.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast(kind).alias("vec"))
    asks = asks.where(F.col("query_id").isNotNull() & valid(F.col("vec"))).distinct().withColumn("h", F.xxhash64("vec"))
    asked = checkpoint(asks.select("h", "vec").distinct().withColumn("d", F.size("vec")).withColumn("q", F.monotonically_increasing_id()))

    models = {}  # a sample of bounded size for each of the most frequent lengths
    for r in classes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(MODELS).collect():
        rows = max(256, min(FIT_FLOATS // r.d, 16_384))
        kept = classes.where(F.col("d") == r.d).orderBy("h").limit(rows).select("vec").toArrow()
        models[r.d] = Model(_matrix(kept["vec"], r.d), min(MAX_CELLS, 1 + r["count"] // CELL_ROWS), k=k, min_bits=CODE_BITS)
    shared = spark.sparkContext.broadcast(models)  # up to MODELS samples of FIT_FLOATS numbers

    def model(d: int) -> Model:
        return shared.value.get(d) or Model(np.zeros((1, d)), 1, k=k, min_bits=CODE_BITS)

    coded = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("code", pa.binary()), ("norm", pa.float32()), ("own", pa.float32()), ("vec", pa.list_(number)), ("ids", pa.list_(pa.int64())), ("h", pa.int64())])

    def encode(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                cell, code, norm, own = model(d).encode(_matrix(part.column("vec"), d))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm.astype(np.float32)), pa.array(own), part.column("vec"), part.column("ids"), part.column("h")], schema=coded)

    index = checkpoint(classes.select("vec", "ids", "d", "h").mapInArrow(encode, f"d int, cell int, code binary, norm float, own float, vec {kind}, ids array<long>, h long"))
    held = index.groupBy("d", "cell").agg(F.max("norm").alias("radius"), F.count("*").alias("n"))
    radius = {d: np.full(len(m.centres), -1.0) for d, m in models.items()}
    for r in held.where(F.col("d").isin(list(models) or [0])).collect():  # at most MODELS * MAX_CELLS rows
        radius[r.d][r.cell] = r.radius

    routed = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("q", pa.int64()), ("vec", pa.list_(number)), ("floor", pa.float64())])

    def route(batches):
        """A row for each cell that a query has to look into, with the query's floor."""
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                for d, part in _by_length(whole.slice(at, _BATCH)):
                    floor, into = model(d).route(_matrix(part.column("vec"), d), radius.get(d, np.full(1, np.inf)))
                    hit, cell = np.nonzero(into)
                    some = part.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), d, np.int32)), pa.array(cell.astype(np.int32)), some.column("q"), some.column("vec"), pa.array(floor[hit])], schema=routed)

    wanted = checkpoint(asked.select("q", "vec", "d").mapInArrow(route, f"d int, cell int, q long, vec {kind}, floor double"))
    sizes = held.join(wanted.groupBy("d", "cell").agg(F.count("*").alias("m")), ["d", "cell"])
    sizes = sizes.select("d", "cell", F.expr(f"1 + (n - 1) div {BLOCK}").alias("blocks"), F.expr(f"1 + (m - 1) div {CHUNK}").alias("chunks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = index.join(sizes, ["d", "cell"]).withColumn("block", F.expr("pmod(h, blocks)")).withColumn("chunk", each("chunks")).drop("blocks", "chunks", "h")
    wanted = wanted.join(sizes, ["d", "cell"]).withColumn("chunk", F.expr("pmod(xxhash64(q), chunks)")).withColumn("block", each("blocks")).drop("blocks", "chunks")

    out_schema = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        d, cell = left["d"][0].as_py(), left["cell"][0].as_py()
        m, v, q = model(d), _matrix(left["vec"], d), _matrix(right["vec"], d)
        code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(v), -1)
        signs, off = m.linear(code, left["norm"].to_numpy(), left["own"].to_numpy(), m.centres[cell])
        signs = np.hstack([signs, off[:, None].astype(np.float32)])  # with the error: upper bounds
        floor, names = right["floor"].to_numpy(), right["q"].to_numpy()
        ids = left["ids"].combine_chunks()
        least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        found = []
        for at in range(0, len(q), _BATCH):
            part, low = q[at : at + _BATCH], floor[at : at + _BATCH]
            upper = signs @ np.hstack([m.turned(part), np.ones((len(part), 1), np.float32)]).T
            with np.errstate(over="ignore", invalid="ignore"):
                least_upper = np.where(np.isneginf(low), low, (low - part @ m.centres[cell]) / np.linalg.norm(part, axis=1))
            rows, cols = np.nonzero(upper >= least_upper.astype(np.float32))
            rows, cols, scores = _best(rows, cols, v, part, least, low, k + 1)
            found.append((names[at + cols], rows, scores))
        got_q, got_v, got_s = map(np.concatenate, zip(*found))
        return pa.Table.from_arrays([pa.array(got_q), ids.take(pa.array(got_v)), pa.array(got_s)], schema=out_schema)

    key = ["d", "cell", "block", "chunk"]
    found = stored.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(scan, "q long, ids array<long>, score double")
    each_id = found.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    lane = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = each_id.withColumn("n", F.row_number().over(lane)).where(F.col("n") <= k + 1)
    top = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    top = top.join(asked.select("q", F.col("h").alias("_h"), F.col("vec").alias("_vec")), "q")
    out = asks.join(top, (F.col("h") == F.col("_h")) & (F.col("vec") == F.col("_vec")))
    out = out.select("query_id", F.expr(f"slice(filter(top, x -> x.vec_id <> query_id), 1, {k})").alias("top"))
    out = out.select("query_id", F.posexplode("top").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = {
    "op1_nearest": """
with e as (
    select vec_id, cast(embedding as double[]) as v from embeddings
    where embedding is not null and vec_id is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score
    from e q join e c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
}
QUERIES = {"op1_nearest": op1_nearest}
