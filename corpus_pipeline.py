"""Corpus pipeline over the documents table: language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents, extra ones
included: columns that the stages add for themselves take names that docs doesn't have.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm import langid, minhash, mixing, packing
from veritab.llm._common import free_names, importable, own_columns, row_hash, scratch, table
from veritab.llm._tokens import tokenizer_path

#: SQL expresses neither the kernel classifier nor the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without text or letters, or that no
    language claims, go.

    Null texts, empty ones and those without letters go; without labelled documents all go; repeated
    rows stay or go together; an empty table stays empty.
    """
    importable(spark)
    names = free_names(docs, "lang_pred", "score", "claimed")
    found = langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang")), names=tuple(names))
    return found.where(F.col(names[2])).select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: word
    5-grams, similarity 0.8 or more.

    Documents without words are no group, and stay. Of a group's rows that share the smallest
    doc_id, the text with the smallest hash stays; of rows with one doc_id and text, the one whose
    columns hash smallest. A null doc_id is never the smallest unless alone. An empty table stays
    empty. Survivors are chosen on narrow rows; the texts are dealt once to meet them.
    """
    importable(spark)
    kept = minhash.near_duplicates(docs, k=5).where("kept").select("doc_id", "text_hash", "n_shingles", "root")
    grouped = kept.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("text_hash", "doc_id")).alias("s")).select("s.doc_id", "s.text_hash")
    stay = grouped.unionByName(kept.where("n_shingles = 0").select("doc_id", "text_hash")).distinct()
    key, none, text_hash, turn = free_names(docs, "id", "no_id", "hash", "turn")
    id_of = lambda c: (F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(key), c.isNull().alias(none))
    stay = stay.select(*id_of(F.col("doc_id")), F.col("text_hash").alias(text_hash))
    own = docs.select("*", *id_of(F.col("doc_id")), F.xxhash64("text").alias(text_hash))
    same = Window.partitionBy(key, none, text_hash).orderBy(row_hash(docs))
    own = own.join(stay, [key, none, text_hash], "left_semi").withColumn(turn, F.row_number().over(same))
    return own.where(F.col(turn) == 1).select(*own_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: it is the order of the files and of their rows.

    No row goes. A null source is a source of its own; null and empty texts are documents like any
    other; rows with one doc_id, source and text are neighbours, in the order of their columns'
    hash; an empty table stays empty.
    """
    importable(spark)
    key, source, text_hash, place, own_hash = free_names(docs, "id", "from", "hash", "place", "own_hash")
    places = mixing.mix(docs.select("doc_id", "source", "text")).select(
        F.col("doc_id").alias(key), F.col("source").alias(source), F.col("_hash").alias(text_hash), F.col("position").alias(place)
    )
    own = docs.withColumn(own_hash, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own_hash) == F.col(text_hash))
    return own.join(places, same).orderBy(place, row_hash(docs)).select(*own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in the order in which the stage before left them (that of
    doc_id where docs isn't read from files).

    A null or empty text is the end id alone; repeated rows are packed one after the other; extra
    columns are not read; an empty table gives no pieces.
    """
    importable(spark)
    order = ["doc_id"]
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        placed = docs
    else:
        placed = placed.withColumn("_part", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long"))
        order = ["_part", "_file", "_row"]
    return packing.pack(placed, tokenizer_path("word_bpe_49k.json"), order=order)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
