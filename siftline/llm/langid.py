"""Language identification by a string kernel with Nystroem landmarks.

The blended-spectrum presence kernel of two texts is the number of character n-grams (of
all lengths up to MAX_N) that both hold, divided by the geometric mean of their numbers
of n-grams.  A bounded sample of labelled texts gives the landmarks; kernel ridge
regression, one output per language, is fitted on landmark features of a larger bounded
sample.  Texts are scored in batches: n-gram presence times landmarks, then times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_N = 3
#: n-grams are hashed to this many places.
PLACES = 1 << 14
#: Sampled rows per language: landmarks, and rows that the regression is fitted on.
LANDMARKS = 40
FIT_ROWS = 400
RIDGE = 1e-3
SHARPNESS = 8.0
BATCH = 64
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_places(text: str) -> np.ndarray:
    """The places of all n-grams of a text, lower case, with repeats."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        key = np.zeros(len(codes), np.uint64)
        for n in range(MAX_N):
            key = key[:len(codes) - n] * _MULTIPLIERS[n] + codes[n:]
            mixed = (key ^ (key >> np.uint64(29))) * _MULTIPLIERS[0]
            found.append((mixed >> np.uint64(64 - 14)).astype(np.int32))
    return np.concatenate(found)


def packed(text: str) -> bytes:
    """The places of a text's n-grams as PLACES bits."""
    bits = np.zeros(PLACES, np.uint8)
    bits[gram_places(text)] = 1
    return np.packbits(bits).tobytes()


def scaled(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, scaled to length one."""
    rows = bits.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def presence(texts: list[str]) -> np.ndarray:
    """One row per text with 1 at the places of its n-grams, scaled to length one."""
    rows = np.zeros((len(texts), PLACES), np.uint8)
    for i, text in enumerate(texts):
        rows[i, gram_places(text)] = 1
    return scaled(rows)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text, one score per language, each row summing to one."""
        kernel = presence(texts) @ self.landmarks
        raw = SHARPNESS * (np.hstack([kernel, np.ones((len(texts), 1), np.float32)]) @ self.weights)
        grown = np.exp(raw - raw.max(1, keepdims=True))
        return grown / grown.sum(1, keepdims=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = pa.array([packed(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), batch.column("text_hash"), bits], names=["lang", "draw", "text_hash", "bits"])


def sample_rows(labelled: DataFrame, text: str, lang: str, key: str, most: int) -> DataFrame:
    """(lang, draw, text_hash, bits, k): ``most`` rows of each language, by the md5 of their key.

    Rows that repeat key and text count once; ties of the key go by the text's hash.  The
    number of keys gives the share of md5 values that holds ``4 * most`` rows on average,
    so that what one task ranks does not grow with the table; a row then weighs PLACES bits.
    """
    usable = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    draw = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    sizes = rows.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("draw", 0.02).alias("_n"))
    near = rows.join(sizes, F.col("lang") == F.col("_lang"))
    near = near.where(F.conv(F.substring("draw", 1, 13), 16, 10).cast("double") * F.col("_n") < 4.0 * most * 16.0**13)
    bits = near.select("lang", "draw", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_packed_rows, "lang string, draw string, text_hash bigint, bits binary")
    ranked = bits.dropDuplicates(["lang", "draw", "text_hash"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text_hash")))
    return ranked.where(F.col("k") <= most)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", landmarks: int = LANDMARKS, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` sampled rows a language, of which ``landmarks`` are landmarks.

    Rows without letters or language are left out; repeated rows count once.  The driver
    gets the sample as PLACES bits a row.  Without any usable row there are no languages.
    """
    sample = sample_rows(labelled, text, lang, key, rows).toPandas().sort_values(["lang", "k"])
    langs = sorted(sample["lang"].unique())
    if not langs:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros((1, 0), np.float32))
    bits = np.stack([np.frombuffer(b, np.uint8) for b in sample["bits"]])
    unpacked = lambda part: scaled(np.unpackbits(part, axis=1))
    chosen = unpacked(bits[(sample["k"] <= landmarks).to_numpy()]).T
    kernel = np.vstack([unpacked(bits[i:i + BATCH]) @ chosen for i in range(0, len(bits), BATCH)]).astype(np.float64)
    wanted = (sample["lang"].to_numpy()[:, None] == np.array(langs)[None]).astype(np.float64) * 2 - 1
    return Model(list(langs), np.ascontiguousarray(chosen), solve(kernel, (chosen.T @ chosen).astype(np.float64), wanted))


def solve(kernel: np.ndarray, among: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights of the landmarks, and a constant, for kernel rows of the sample.

    ``among`` is the kernel of the landmarks among themselves.  Ridge regression on the
    features ``kernel @ root`` with ``root @ root.T`` the inverse of ``among``.
    """
    values, vectors = np.linalg.eigh(among)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    gram = features.T @ features / len(features) + RIDGE * np.eye(features.shape[1])
    ridge = np.linalg.solve(gram, features.T @ wanted / len(features))
    return np.vstack([root @ ridge[:-1], ridge[-1:]]).astype(np.float32)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score of every whole text.

    Texts that are null or hold no letter get ``und`` with score 0, as do all texts when
    the model knows no language.  The model is a bounded table; it is sent to each task.
    """
    rows = docs.select(*keep, F.when(has_letter(F.col(text)), F.col(text)).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch.column("_text")
            at = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)) if known.langs else np.zeros(0, int)
            lang, value = np.full(len(texts), "und", object), np.zeros(len(texts))
            for i in range(0, len(at), BATCH):
                part = at[i:i + BATCH]
                scores = known.scores([texts[int(k)].as_py() for k in part])
                lang[part] = np.array(known.langs, object)[scores.argmax(1)]
                value[part] = scores.max(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(value)], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the crc32 of its id; documents without id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def predict_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """Learn from the documents not held out, then predict every document.

    Returns doc_id, held_out, lang_pred and score; one row per row of ``docs``.  Equal
    scores go to the language first in code-point order; repeated rows weigh once in the
    fit and get equal predictions; null ids are held out; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where(~F.col("held_out")), **sizes)
    return predict(rows, model, keep=("doc_id", "held_out"))
