"""Language identification by error-correcting output codes.

Each language gets a codeword; a binary classifier for each bit, over hashed byte n-grams of the text, says how far the bit is
set. Decoding weighs each bit's loss by how well its classifier does on the language in question, takes the language of the
smallest weighted loss and flags texts whose two best languages lie close together.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part, map_batches

#: Bound of the training sample: rows of a language, about; chosen by a hash of the id.
ROWS_OF_A_LANGUAGE = 800
BUCKETS = 1 << 13
SEED = 7
#: A text is ambiguous if the best language's share is below this.
SURE = 0.6
UNKNOWN = "und"
#: ASCII bytes that are no letters count as one: a space. Others keep their value.
PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of hashed counts of byte 2- and 3-grams of the lower-cased text, of length 1."""
    b = PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(two >> shift, minlength=BUCKETS) + np.bincount(three >> shift, minlength=BUCKETS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(1e-9, float(np.linalg.norm(x)))


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """A row of -1 and 1 for each language: all different splits for up to 5 languages, else the best of many random draws."""
    if languages <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, languages - 1)) if -1 in rest]
        return np.array(splits, dtype=np.int8).T if splits else np.ones((languages, 1), np.int8)
    bits, draw, best, most = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(apart[~np.eye(languages, dtype=bool)].min())
        if least > most and (np.abs(code.sum(0)) < languages).all():
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share, a soft minimum of the losses."""
        loss = self.losses(x)
        share = np.exp(4 * (loss.min(1, keepdims=True) - loss))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(x)), best]


def fit(x: np.ndarray, y: list[str], steps: int = 300) -> Model:
    """Logistic regression for each bit, languages weighing alike, by accelerated gradient steps."""
    languages = sorted(set(y))
    target = np.array([languages.index(v) for v in y])
    code = codewords(len(languages))
    signs = code[target].astype(np.float32)
    share = (1.0 / (np.bincount(target)[target] * len(languages))).astype(np.float32)[:, None]
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    w_old, b_old = w, bias
    for step in range(1, steps + 1):
        push = (step - 1) / (step + 2)
        w_try, b_try = w + push * (w - w_old), bias + push * (bias - b_old)
        slope = -signs * share / (1 + np.exp(signs * (x @ w_try + b_try)))
        w_old, b_old = w, bias
        w, bias = w_try - 8.0 * (x.T @ slope + 1e-5 * w_try), b_try - 8.0 * slope.sum(0)
    right = (np.sign(x @ w + bias) == signs).astype(float)
    trust = np.stack([right[target == k].mean(0) for k in range(len(languages))]) + 1e-3
    return Model(languages, code, w, bias, trust / trust.sum(1, keepdims=True))


def training_rows(docs: DataFrame, per_language: int = ROWS_OF_A_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of a sample of rows with text and lang whose crc32(doc_id as text) mod 4 is not 2."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_part() != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, BUCKETS), np.float32), []
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    rate = F.create_map(*(F.lit(v) for pair in ((k, min(1.0, per_language / n)) for k, n in counts.items()) for v in pair))
    chosen = known.where(place < rate[F.col("lang")])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(features(t).astype(np.float16).tobytes(), 1) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "x"])

    got = map_batches(chosen, one, "doc_id bigint, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = [np.frombuffer(zlib.decompress(v), np.float16).astype(np.float32) for v in got.column("x").to_pylist()]
    return np.stack(x), got.column("lang").to_pylist()


def identify(docs: DataFrame, model: Model | None = None, per_language: int = ROWS_OF_A_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of docs (doc_id, text, lang).

    Texts that are null or have no letter are `und` with score 0 and ambiguous; so are all if there is nothing to learn from. A
    null doc_id counts as empty text in the split. Repeated rows repeat; an empty table gives no rows; more columns are ignored.
    lang is read for training only; a text is predicted from its text alone.
    """
    if model is None:
        x, y = training_rows(docs, per_language)
        model = fit(x, y) if y else None

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        told = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if told:
            best, share = model.decode(np.stack([features(texts[i]) for i in told]))
            for i, k, s in zip(told, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = model.languages[k], s
        columns = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < SURE)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", "text", (crc_part() == 2).alias("held_out"))
    return map_batches(rows, one, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
