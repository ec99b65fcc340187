"""A quality classifier from compressed sizes under two dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read
from .tokenizing import texts_of

#: The fit's sample: at most this many labelled texts of each label, of at most this many bytes each, those with the
#: smallest digests of their ids. All else is done on all rows.
SAMPLE_TEXTS, SAMPLE_BYTES = 1200, 16_000
#: Bytes of a dictionary, and bytes of text compressed at a time: in a short window most matches are with the dictionary,
#: not with the text itself. The level decides how hard the compressor looks for them.
DICTIONARY_BYTES, WINDOW_BYTES = 64_000, 300
LEVEL = 12
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the calibration's slope and constant."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(model: Model):
    import zstandard as z

    of = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    return of(model.good), of(model.bad)


def difference(model: Model, text: str | None) -> float:
    """How many bytes less the good dictionary takes for the text than the bad one, for each byte of the text. The whole text
    counts, a window at a time; 0 for null and empty."""
    raw = (text or "").encode()
    if not raw:
        return 0.0
    good, bad = _compressors(model)
    windows = [raw[at : at + WINDOW_BYTES] for at in range(0, len(raw), WINDOW_BYTES)]
    return sum(len(bad.compress(w)) - len(good.compress(w)) for w in windows) / len(raw)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method. counts: how many rows each row stands for, 1 by default."""
    w = np.zeros(x.shape[1])
    counts = np.ones(len(y)) if counts is None else counts
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """Pieces of all texts in turn, until the dictionary is full; each text gives the same share from its middle."""
    share = max(200, DICTIONARY_BYTES // max(1, len(texts)))
    pieces, size = [], 0
    for t in texts:
        at = max(0, (len(t) - share) // 2)
        pieces.append(t[at : at + share])
        size += len(pieces[-1])
        if size >= DICTIONARY_BYTES:
            break
    return b"\n".join(pieces) or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Dictionaries and calibration from a bounded sample of labelled rows.

    docs: key and text; labels: key and a label of 0 or 1 (others and null are left out, as are null texts). Half of the
    sample makes the dictionaries, the other half the calibration, so that it sees texts the dictionaries do not hold.
    The calibration weights both labels by their shares of all label rows, which the sample's bound does not change.
    Labels that occur in only one kind give a model that scores by the share of good labels alone.
    """
    wanted = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    rank = F.md5(F.col("_key").cast("string"))
    chosen = []
    for value in (0, 1):
        near = wanted.where(F.col("_label") == value).withColumn("_rank", rank).orderBy("_rank").limit(2 * sample_texts)
        chosen.append(near)
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 4 * sample_texts ids
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.octet_length("_text").between(1, SAMPLE_BYTES))
    rows = texts.join(few, "_key").select("_label", "_rank", "_text").collect()  # bounded by the sample
    by = {v: [r["_text"].encode() for r in sorted(rows, key=lambda r: (r["_rank"], r["_text"])) if r["_label"] == v][:sample_texts] for v in (0, 1)}
    of = {0: 0, 1: 0} | {r["_label"]: r["count"] for r in wanted.groupBy("_label").count().collect()}  # at most two rows
    base = (of[1] + 1) / (of[0] + of[1] + 2)
    if not by[0] or not by[1]:
        return Model(b" " * 8, b" " * 8, (0.0, float(np.log(base / (1 - base)))))
    model = Model(_dictionary(by[1][::2]), _dictionary(by[0][::2]), (0.0, 0.0))
    held = [(t, v) for v in (0, 1) for t in by[v][1::2]]
    found = np.array([difference(model, t.decode()) for t, _ in held])
    scale = float(found.std()) if len(found) and found.std() > 0 else 1.0
    x = np.stack([found / scale, np.ones(len(found))], 1)
    y = np.array([v for _, v in held], float)
    n = {v: len(by[v][1::2]) for v in (0, 1)}
    counts = np.array([of[v] / (of[0] + of[1]) * len(held) / n[v] for _, v in held])
    if not len(y):
        return model
    slope, constant = calibrate(x, y, counts=counts)
    if slope < 0:  # the good dictionary says nothing of good texts here; chance must not turn the score round
        slope, constant = 0.0, calibrate(x[:, 1:], y, counts=counts)[0]
    return Model(model.good, model.bad, (float(slope / scale), float(constant)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """docs with column `name`, 0 to 1, higher where label 1 is likelier: the calibrated difference of the two compressed
    sizes, and nothing else. Each row is scored by its text alone, whole; null and empty texts by the calibration's
    constant. No shuffle. docs keeps its columns."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    slope, constant = model.weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            x = np.array([difference(m, t) for t in texts_of(b, text)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sigmoid(slope * x + constant))], [*b.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(key: str = "doc_id"):
    """The fifth of the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark, sf_dir: str) -> Model:
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out())
    return fit(read(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fitted(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
