"""Language ID by blended-spectrum string kernels.

A text's features are the distinct n-grams, n = 1 to 3, of its lower-cased UTF-8 bytes: presence, not
counts. The kernel of two texts is the mean over n of |common n-grams| / sqrt(|n-grams| * |n-grams|).
Landmark texts stand for the kernel (Nystroem): a text's features are its kernel values with the
landmarks times the inverse square root of the landmarks' own kernel matrix, and one ridge
regression per language, fitted one against the rest, scores them. A batch of texts is scored with
two matrix products: presence by landmark presence, then by the folded weights.

Fitting reads at most PER_LANGUAGE labelled documents of each language, those with the smallest
hashes of their doc_id, and FIT_MAX in all: bounds that are parameters. Their n-gram sets are made
on the executors. Prediction reads every whole text; its memory is that of the text's own n-grams.

The regressions' scores of any text sum to 2 - L over L languages, so the best of them can't tell
that no language fits. That is told by coverage: the share of a text's 3-grams of letters which two
or more labelled documents of a language have. A language claims a text unless the coverage, with
two standard errors 1/sqrt(3-grams) added, is under CLAIM of what the language's own labelled
documents reach (their 5 percent quantile, each against the others). A text without such 3-grams
is claimed, as is one predicted as a language of fewer than CLAIM_FROM labelled documents, which
have no quantile.

Defined results: null texts, and texts without any letter, are "und" with score 0; a null doc_id is
not held out and not learned from; with no labelled documents all are "und"; equal scores go to the
language that sorts first; repeated rows get equal results; an empty table gives no rows; extra
columns are kept by `identify` under their names (the names of its own get underscores before them
where the table has such a column), and not read by the query; of rows that repeat a labelled one,
one is learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_names, table

PER_LANGUAGE, FIT_MAX = 160, 2048
LANDMARKS_PER_LANGUAGE, LANDMARKS_MAX = 40, 240
RIDGE, UNKNOWN = 1e-3, "und"
CLAIM, CLAIM_FROM = 0.5, 8
_LETTER = re.compile(r"[^\W\d_]")
_OFFSETS = (0, 1 << 8, (1 << 8) + (1 << 16))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[128:] = True


def ngrams(text: str) -> list[np.ndarray]:
    """The codes of the distinct byte 1-, 2- and 3-grams."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) < 3:
        grams = [np.unique(b).astype(np.int64), np.unique(b[:-1].astype(np.int64) << 8 | b[1:]) if len(b) == 2 else np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return [g + o for g, o in zip(grams, _OFFSETS)]
    wide = b.astype(np.int32)
    three = np.unique(wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])
    two = np.unique(np.append(three >> 8, wide[-2] << 8 | wide[-1]))
    one = np.unique(np.append(two >> 8, wide[-1]))
    return [g.astype(np.int64) + o for g, o in zip((one, two, three), _OFFSETS)]


def spelled(three: np.ndarray) -> np.ndarray:
    """The codes of the 3-grams that are letters only (all bytes beyond ASCII count as such)."""
    b = three - _OFFSETS[2]
    return three[_IN_WORD[b >> 16] & _IN_WORD[b >> 8 & 255] & _IN_WORD[b & 255]]


class Classifier:
    """Learned from (language, n-gram codes) of labelled texts."""

    def __init__(self, labels: list[str], grams: list[list[np.ndarray]], landmarks: list[int], ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        self.known = np.unique(np.concatenate([c for i in landmarks for c in grams[i]]))
        self.width = len(self.known)
        self.landmarks = self.rows([grams[i] for i in landmarks])
        own = (self.landmarks @ self.landmarks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(own)
        values = np.maximum(values, 1e-6)
        root = vectors / np.sqrt(values) @ vectors.T
        z = np.concatenate([self.rows(grams[i : i + 256]) @ self.landmarks.T for i in range(0, len(grams), 256)]).astype(np.float64) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.languages), 1.0, -1.0)
        penalty = ridge * len(z) * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1]
        self.learn_coverage(labels, [spelled(g[2]) for g in grams])

    def learn_coverage(self, labels: list[str], letters: list[np.ndarray]) -> None:
        self.codes = np.unique(np.concatenate(letters))
        self.shared = np.zeros((len(self.languages), len(self.codes)), bool)
        self.floor = np.full(len(self.languages), np.nan)
        for i, language in enumerate(self.languages):
            own = [np.searchsorted(self.codes, g) for g, l in zip(letters, labels) if l == language and len(g)]
            n = np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=len(self.codes))
            self.shared[i] = n >= 2
            if len(own) >= CLAIM_FROM:
                self.floor[i] = CLAIM * np.quantile([(n[at] >= 3).mean() for at in own], 0.05)

    def claimed(self, letters: np.ndarray, best: int) -> bool:
        """Whether any language claims a text of these 3-grams of letters; best: the predicted one."""
        if not len(letters) or np.isnan(self.floor[best]):
            return True
        at = np.searchsorted(self.codes, letters)
        at = at[self.codes[np.minimum(at, len(self.codes) - 1)] == letters]
        coverage = self.shared[:, at].sum(1) / len(letters) + 1 / np.sqrt(len(letters))
        return bool((coverage >= self.floor).any())

    def rows(self, grams: list[list[np.ndarray]]) -> np.ndarray:
        """Presence over the landmarks' n-grams, each n scaled by its whole text's count."""
        out = np.zeros((len(grams), self.width), np.float32)
        for row, sets in zip(out, grams):
            for codes in sets:
                if len(codes):
                    at = np.minimum(np.searchsorted(self.known, codes), self.width - 1)
                    row[at[self.known[at] == codes]] = 1 / np.sqrt(3 * len(codes))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        grams = [ngrams(t or "") for t in texts]
        kernel = self.rows(grams) @ self.landmarks.T
        scores = kernel @ self.weights + self.bias
        best = scores.argmax(1)
        out = [self.languages[b] if t and _LETTER.search(t) else UNKNOWN for t, b in zip(texts, best)]
        score = [float(np.clip((s[b] + 1) / 2, 0, 1)) if o != UNKNOWN else 0.0 for s, b, o in zip(scores, best, out)]
        return out, score, [o != UNKNOWN and self.claimed(spelled(g[2]), b) for g, b, o in zip(grams, best, out)]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, fit_max: int = FIT_MAX) -> Classifier | None:
    """A classifier from (doc_id, text, lang); lang and doc_id not null."""
    known = labelled.where("doc_id is not null and lang is not null")
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    picked = known.select("doc_id", "lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    picked = picked.where(F.col("n") <= per_language).orderBy("n", *order).limit(fit_max)
    texts = known.join(F.broadcast(picked), ["doc_id", "lang", "h"]).dropDuplicates(["lang", "n"])  # at most fit_max rows, also of repeated ones

    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("doc_id", pa.int64())] + [(f"g{i}", pa.list_(pa.int64())) for i in (1, 2, 3)])

    def run(batches):
        for batch in batches:
            for doc_id, lang, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "n", "text"))):
                if text and _LETTER.search(text):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "n": n, "doc_id": doc_id} | {f"g{i + 1}": g for i, g in enumerate(ngrams(text))}], schema)

    got = texts.mapInArrow(run, "lang string, n int, doc_id long, g1 array<long>, g2 array<long>, g3 array<long>").toArrow()
    rows = sorted(range(got.num_rows), key=lambda i: (got["n"][i].as_py(), got["lang"][i].as_py(), got["doc_id"][i].as_py()))
    if not rows:
        return None
    labels = [got["lang"][i].as_py() for i in rows]
    grams = [[np.array(got[f"g{j}"][i].as_py(), np.int64) for j in (1, 2, 3)] for i in rows]
    landmarks = [i for i, r in enumerate(rows) if got["n"][r].as_py() <= LANDMARKS_PER_LANGUAGE][:LANDMARKS_MAX]
    return Classifier(labels, grams, landmarks or list(range(min(len(rows), LANDMARKS_MAX))))


def identify(docs: DataFrame, model: Classifier | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "claimed")) -> DataFrame:
    """docs with, by the names, the predicted language, its score, and whether any language claims the text."""
    names = free_names(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS_MAX rows of n-grams
    plain, place = [f"c{i}" for i in range(len(docs.columns) + 3)], docs.columns.index(text_col)
    kinds = [*[f.dataType for f in docs.schema], T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*map(T.StructField, plain, kinds)])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(place).to_pylist()
                if shared.value is None:
                    found = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                else:
                    found = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=plain)

    return docs.toDF(*plain[:-3]).mapInArrow(run, schema).toDF(*docs.columns, *names)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
