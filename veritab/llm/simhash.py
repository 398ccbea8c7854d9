"""SimHash document fingerprints and permuted block tables, with DataFrame functions only.

Terms are the text's word 5-grams (lower-cased words between white space; a text of fewer words is
one term, a text without words the empty term). A term's weight is its number of occurrences: each
occurrence votes with the 64 signed bits of its xxhash64, and the fingerprint holds the signs. The
32 sums of an aggregate each count two bits, bit i in the low and bit i + 32 in the high half of a
long; a text has under 2**31 terms, so the halves never meet. Terms are exploded and summed inside
one stage: one row per text and task is shuffled, never a term.

near_tables finds all fingerprints within a Hamming radius: 64 bits fall into blocks, and for every
choice of blocks - radius blocks a table is keyed by those bits; two fingerprints within the radius
agree on all bits of at least one choice. Only distinct fingerprints enter the tables.

Defined results: a null text is an empty one; equal texts have equal fingerprints; documents with
a null doc_id stand last in the descending order, as one group; of rows that share a doc_id, the
next document is the one with the smallest text hash, and each row keeps its own result; an empty
table gives no rows; a single document is its own next one; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, once, positions, table

SHINGLE = 5
RADIUS = 3
BLOCKS = 5
PAIRED = 0x100000001


def words_of(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(keys, _copies, fp) for each distinct combination of the keys, which must determine the text.

    A term is hashed from its words where it starts, so a text's words are held, not its terms.
    """
    each = texts.select(*keys, once(words_of(F.col(text_col))).alias("_words"))
    each = each.withColumn("_n", F.greatest(F.size("_words") - (shingle - 1), F.lit(1)))
    each = each.select(*keys, "_n", "_words", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    each = each.select(*keys, "_n", F.xxhash64(*[F.get("_words", F.col("_i") + i) for i in range(shingle)]).alias("_term"))
    votes = [F.sum(F.shiftrightunsigned("_term", i).bitwiseAND(F.lit(PAIRED))).alias(f"v{i}") for i in range(32)]
    summed = each.groupBy(*keys, "_n").agg(F.count("*").alias("_count"), *votes)

    def bit(i: int) -> Column:
        ones = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) if i < 32 else F.shiftrightunsigned(f"v{i - 32}", 32)
        return F.when(2 * ones > F.col("_count"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))

    fp = reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(64)])
    return summed.select(*keys, F.expr("_count div _n").alias("_copies"), fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of differing bits."""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def hexed(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_tables(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_fp, fp) of all pairs within the radius, a fingerprint's pair with itself included.

    queries and fps each have distinct fingerprints in column fp.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    kept = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in choice) for choice in kept]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
        return df.select(F.col("fp").alias(name), F.inline(keys))

    found = keyed(queries, "query_fp").join(keyed(fps, "fp"), ["t", "k"])
    return found.where(F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))) <= radius).select("query_fp", "fp").distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """(_k, _z, text, _h, n_chars, _nk, _nz, _next_h, edited): each document and its edited text.

    _k, _z: the doc_id, 0 for null, and whether it is null; _nk, _nz: the next document's. Both joins
    deal the texts by the same columns, so that they are shuffled once; of next documents only the
    heads that are taken are.
    """
    own = docs.select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_k"), F.col("doc_id").isNull().alias("_z")
    )
    ids = own.groupBy("_k", "_z").agg(F.max(F.expr("length(text) div 3")).alias("_need"))
    ids = positions(ids, [F.col("_z"), F.col("_k").desc()])
    count = ids.agg(F.count("*").alias("_all"))
    turned = ids.join(F.broadcast(count)).select(  # one row
        F.col("_k").alias("_pk"), F.col("_z").alias("_pz"), F.expr("pmod(_pos + 1, _all)").alias("_pos"), F.col("_need").alias("_taken")
    )
    links = turned.join(ids.select("_pos", "_k", "_z"), "_pos").drop("_pos")
    head = F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, cast(_taken as int))").alias("head"))
    heads = own.join(links, ["_k", "_z"]).groupBy("_pk", "_pz").agg(F.min(head).alias("_first"), F.max("_k").alias("_nk"), F.max("_z").alias("_nz"))
    both = own.join(heads.withColumnsRenamed({"_pk": "_k", "_pz": "_z"}), ["_k", "_z"])
    cut = F.expr("length(text) div 3").cast("int")
    return both.select(
        "_k", "_z", "text", F.xxhash64("text").alias("_h"), F.length("text").cast("long").alias("n_chars"), "_nk", "_nz", F.col("_first.h").alias("_next_h"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("_first.head"), F.lit(1), cut)).alias("edited"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, n_within: for documents whose id is divisible by 100, how many
    documents have a fingerprint within RADIUS bits, itself included, found by the block tables."""
    pairs = with_next(table(spark, sf_dir, "documents"))
    keys = ["_k", "_z", "_h", "n_chars", "_nk", "_nz", "_next_h", "edited_sha256"]
    body = lambda kind, c: F.struct(F.lit(kind).alias("_kind"), F.col(c).alias("_body"))
    both = pairs.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.inline(F.array(body(0, "text"), body(1, "edited"))))
    fps = fingerprints(both, [*keys, "_kind"], "_body")
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("fp")))
    found = checkpoint(fps.groupBy(*keys).agg(F.max("_copies").alias("_copies"), of(0).alias("fp"), of(1).alias("edited_fp")))
    known = found.select(F.col("_k").alias("_nk"), F.col("_z").alias("_nz"), F.col("_h").alias("_next_h"), F.col("fp").alias("next_fp")).distinct()
    asks = ~F.col("_z") & (F.col("_k") % 100 == 0)
    distinct = found.groupBy("fp").agg(F.sum("_copies").alias("_docs"), F.max(asks).alias("_asks"))
    near = near_tables(distinct.where("_asks").select("fp"), distinct.select("fp"))
    near = near.join(distinct.select("fp", "_docs"), "fp").groupBy(F.col("query_fp").alias("fp")).agg(F.sum("_docs").alias("n_within"))
    out = found.join(known, ["_nk", "_nz", "_next_h"]).join(near, "fp", "left")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(
        F.when(~F.col("_z"), F.col("_k")).alias("doc_id"), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.when(asks, F.col("n_within")).alias("n_within"),
    )


QUERIES = {"op9_simhash": op9_simhash}
