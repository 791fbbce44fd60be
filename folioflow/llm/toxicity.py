"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words, how near they stand to the second person, capitals, punctuation and
signs of obfuscation. The lexicon is a short fixed list, widened by words and word beginnings that mark toxic rows of one
bounded sample of labelled rows; trees and calibration learn from two others.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, crc_part, map_batches, saved

#: Bounds of the three samples of labelled rows, about, chosen by a hash of the id: toxic and other rows for the lexicon, rows
#: for the trees, rows for the calibration.
LEXICON_TOXIC, LEXICON_OTHER, TREE_ROWS, CALIBRATION_ROWS = 3000, 3000, 8000, 4000
#: Learned units kept at most, the strongest first.
LEXICON_UNITS = 20_000
SEED = 11
THRESHOLD = 0.3
#: Words within this distance of a second person count as aimed at it.
NEAR = 5
REMEMBERED_WORDS = 300_000

SEEDS = frozenset("idiot moron stupid scum trash loser worthless pathetic disgusting clown dumb filth vermin retard".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Look-alikes of letters.
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")
LETTERS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W\d_][0-9@$!*#+|.\-_]+[^\W\d_]|[0-9@$!|+][^\W\d_]{2,}")
REPEATS = re.compile(r"(.)\1{2,}")
PREFIXES = (3, 4, 5, 6, 7, 8)
NAMES = ("n", "seeds", "learned", "begun", "hidden", "near", "share", "share_begun", "aimed", "capital", "shouted", "exclaimed", "asked", "punctuation", "mixed", "strength", "strongest")


def plain(word: str) -> str:
    """The letters of a word, lower-cased."""
    return "".join(LETTERS.findall(word)).lower()


def unveiled(word: str) -> str:
    """A word without look-alikes, separators and drawn-out letters."""
    return REPEATS.sub(r"\1", "".join(LETTERS.findall(word.strip(".,;:!?\"'()").lower().translate(LOOKALIKES))))


def units(word: str) -> list[str]:
    """What the lexicon can hold of a plain word: itself, and its beginnings."""
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]


class Words(dict):
    """Word to a row of marks: seed, learned, begun, hidden, second person, capitals, shouted, mixed, strength."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple:
        letters = plain(word)
        found = [self.lexicon.get(u, 0.0) for u in units(letters)] if letters else [0.0]
        mixed = bool(MIXED.search(word))
        bare = unveiled(word) if mixed or REPEATS.search(word) else letters
        hidden = bare != letters and (bare in SEEDS or f"={bare}" in self.lexicon)
        seed = letters in SEEDS
        marks = (seed, found[0] > 0, max(found[1:], default=0.0) > 0, hidden, letters in SECOND_PERSON, word[:1].isupper(), len(letters) > 1 and word.isupper(), mixed, max(found))
        if len(self) < REMEMBERED_WORDS:
            self[word] = marks
        return marks


def features(text: str | None, words: Words) -> np.ndarray:
    found = WORD.findall(text or "")
    n = len(found)
    if not n:
        return np.zeros(len(NAMES), np.float32)
    marks = np.array(list(map(words.__getitem__, found)), dtype=np.float32)
    bad = np.flatnonzero(marks[:, [0, 1, 2, 3]].any(1))
    told = np.flatnonzero(marks[:, 4])
    aimed = 0
    if len(bad) and len(told):
        after = np.searchsorted(told, bad)
        gap = np.minimum(np.abs(told[np.minimum(after, len(told) - 1)] - bad), np.abs(told[np.maximum(after - 1, 0)] - bad))
        aimed = int((gap <= NEAR).sum())
    sums = marks.sum(0)
    chars = max(1, len(text))
    exclaimed, asked = text.count("!"), text.count("?")
    points = exclaimed + asked + sum(text.count(c) for c in ".,;:*#%$&|")
    top = np.sort(marks[:, 8])[::-1][:5]
    return np.array(
        [np.log1p(n), sums[0], sums[1], sums[2], sums[3], aimed, (sums[0] + sums[1]) / n, sums[2] / n, aimed / n, sums[5] / n, sums[6] / n, exclaimed / n, asked / n, points / chars, sums[7] / n, top.sum(), top[0]],
        dtype=np.float32,
    )


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features, as arrays: feature and bin of each inner node, value of each leaf."""

    edges: list[np.ndarray]
    start: float
    nodes: np.ndarray  # trees x inner nodes x (feature, bin)
    leaves: np.ndarray  # trees x leaves

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for nodes, leaves in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            while len(at) and at[0] < len(nodes):
                at = 2 * at + 1 + (bins[rows, nodes[at, 0]] > nodes[at, 1])
            out += leaves[at - len(nodes)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [np.union1d(e, [x[:, j].min()]) for j, e in enumerate(edges)]
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    trees = Trees(edges, float(np.log(base / (1 - base))), np.zeros((0, 2**depth - 1, 2), int), np.zeros((0, 2**depth)))
    binned, score, all_nodes, all_leaves = trees.binned(x), np.full(len(x), trees.start), [], []
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        at, nodes = np.zeros(len(x), int), np.zeros((inner, 2), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, bins + 2)  # no split: all go left
            for j in range(x.shape[1]):
                width = len(edges[j]) + 1
                g = np.cumsum(np.bincount(binned[rows, j], slope[rows], width))
                h = np.cumsum(np.bincount(binned[rows, j], curve[rows], width))
                gain = g**2 / (h + ridge) + (g[-1] - g) ** 2 / (h[-1] - h + ridge) - g[-1] ** 2 / (h[-1] + ridge)
                n = np.cumsum(np.bincount(binned[rows, j], minlength=width))
                gain[(n < least) | (n[-1] - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            nodes[node] = best[1:]
            at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        values = -rate * g / (h + ridge)
        score += values[leaf]
        all_nodes.append(nodes)
        all_leaves.append(values)
    trees.nodes, trees.leaves = np.stack(all_nodes), np.stack(all_leaves)
    return trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling neighbours that fall; one row of each class is added as prior."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest raw, highest raw
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    to = np.array([v for b in blocks for v in 2 * ((b[0] + y.mean()) / (b[1] + 1),)])
    return at, np.maximum.accumulate(to)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    to: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of them keeps the trees' order within a step."""
        if self.trees is None:
            return np.full(len(x), float(self.to[0]))
        raw = self.trees.raw(x)
        return np.clip(0.999 * np.interp(raw, self.at, self.to) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _sampled(marks: DataFrame, counts: dict[int, int]) -> DataFrame:
    """doc_id, toxic, use of about as many labelled rows as the bounds allow; each use has a third of a hash's range."""
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows, use = sum(counts.values()), F.lit(None)
    for label, n in counts.items():
        for k, wanted in enumerate((LEXICON_TOXIC if label else LEXICON_OTHER, TREE_ROWS * n / rows, CALIBRATION_ROWS * n / rows)):
            use = F.when((F.col("toxic") == label) & (place >= k / 3) & (place < k / 3 + min(1 / 3, wanted / n)), k).otherwise(use)
    return marks.withColumn("use", use.cast("int")).where("use is not null")


def learn_lexicon(rows: DataFrame, bound: int = LEXICON_UNITS) -> dict[str, float]:
    """Units that mark toxic rows, with the logarithm of how much more often they stand there."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {plain(w) for w in set(WORD.findall(text or ""))} - {""}
            (toxic if label else other).update({u for w in words for u in units(w)})
        # A unit of no toxic row of this batch can still lower the odds of one of another batch.
        names = sorted(toxic.keys() | other.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([other[u] for u in names], pa.int64())], ["unit", "toxic", "other"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return {}
    counts = map_batches(rows.select("text", "toxic"), one, "unit string, toxic bigint, other bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log(((F.col("toxic") + 0.1) / totals[1]) / ((F.col("other") + 0.5) / max(1, totals.get(0, 0))))
    strong = counts.withColumn("odds", odds).where((F.col("toxic") >= max(3, totals[1] // 400)) & (F.col("odds") > 1.5))
    return {r["unit"]: r["odds"] for r in strong.orderBy(F.desc("odds"), "unit").limit(bound).collect()}


def featurized(rows: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(lexicon)
        x = [features(t, words).tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column("toxic").cast(pa.int32())], ["x", "toxic"])

    got = map_batches(rows.select("text", "toxic"), one, "x array<float>, toxic int").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float32).reshape(-1, len(NAMES))
    y = np.array(got.column("toxic").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2; three bands of a hash keep the uses apart."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull() & (crc_part() != 2))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    none = Model({}, None, np.zeros(1), np.array([counts.get(1, 0) / max(rows, 1)]))
    if len(counts) < 2:
        return none
    # The sample is bounded, so that its ids are sent to the texts, which are read once and stay where they are.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = saved(texts.join(F.broadcast(_sampled(marks, counts)), "doc_id"), "labelled")
    lexicon = learn_lexicon(sample.where("use = 0"))
    x, y = featurized(sample.where("use = 1"), lexicon)
    if not 0 < y.sum() < len(y):
        return none
    trees = boost(x, y)
    cx, cy = featurized(sample.where("use = 2"), lexicon)
    if not 0 < cy.sum() < len(cy):
        cx, cy = x, y
    return Model(lexicon, trees, *isotonic(trees.raw(cx), cy))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Null and empty texts are scored like texts without words; a null doc_id counts as empty text in the split; repeated rows
    repeat; an empty table gives no rows; more columns are ignored. Without labels of both kinds each score is their mean.
    """
    tables: dict[str, Words] = {}  # one for a worker

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tables.setdefault("words", Words(model.lexicon))
        x = np.stack([features(t, words) for t in batch.column("text").to_pylist()])
        s = model.scores(x)
        columns = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", (crc_part() == 2).alias("held_out"))
    return map_batches(rows, one, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score at least threshold: one pass, in which each row is scored where it stands."""
    tables: dict[str, Words] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tables.setdefault("words", Words(model.lexicon))
        s = model.scores(np.stack([features(t, words) for t in batch.column("text").to_pylist()]))
        return batch.filter(pa.array(s < threshold))

    return map_batches(docs, one, docs.schema)
