"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces reads a text once. At each position it follows its output links, so that
every piece ending there relaxes the best score of the prefix it completes (a Viterbi pass): the result is the segmentation
with the highest sum of piece scores, whatever order of merges the model was trained with. Of equal scores, the longer last
piece wins. A character that no piece covers becomes its UTF-8 bytes, at the cost of UNKNOWN_BELOW under the lowest score.

No piece reaches over the start of a space-marked word, so that a text is the sequence of its words and each different word
is segmented once for a worker (the memory of words is bounded).
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_batches

SPACE = "▁"
UNKNOWN_BELOW = 10.0
REMEMBERED_WORDS = 300_000
ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, score double"


class Pieces(dict):
    """Words to (ids as bytes, score), filled as words are met."""

    def __init__(self, path: str) -> None:
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.unknown = model.unk_id()
        usable = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {i: model.get_score(i) for i in usable}
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_BELOW
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        if usable:
            self.automaton.make_automaton()
        inner = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.cut = None if inner else re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

    def normalize(self, text: str) -> str:
        """A space-marked text with a mark in front, as models without further rules take it; empty stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def viterbi(self, text: str) -> tuple[list[int], float]:
        n = len(text)
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        ends = self.automaton.iter(text) if self.scores else iter(())
        match = next(ends, None)
        for at in range(1, n + 1):
            top, how = -math.inf, None
            while match is not None and match[0] == at - 1:
                length, score, i = match[1]
                if best[at - length] + score > top or best[at - length] + score == top and at - length < how[0]:
                    top, how = best[at - length] + score, (at - length, i)
                match = next(ends, None)
            if best[at - 1] + self.unknown_score > top:
                top, how = best[at - 1] + self.unknown_score, (at - 1, -1)
            best[at], back[at] = top, how
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[start:at].encode())]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1], best[n]

    def __missing__(self, word: str) -> tuple[bytes, float]:
        ids, score = self.viterbi(word)
        found = np.array(ids, dtype="<i4").tobytes(), score
        if len(self) < REMEMBERED_WORDS:
            self[word] = found
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        parts = (text or "").split(SPACE) if self.byte_ids else [text or ""]
        if parts == [""]:
            return np.zeros(0, "<i4"), 0.0
        found = self._found(SPACE + parts[0].replace(" ", SPACE))
        for part in parts[1:]:  # a mark in the text itself is written by its bytes, so that it is told from a space
            found += [self.own_mark, *self._found(part.replace(" ", SPACE))]
        return np.frombuffer(b"".join([f[0] for f in found]), "<i4"), math.fsum(f[1] for f in found)

    def _found(self, marked: str) -> list[tuple[bytes, float]]:
        if not marked:
            return []
        words = self.cut.split(marked) if self.cut else [marked]
        # A line feed that belongs to no longer piece is a word of its own, which keeps the words around it common.
        return [self[w] for x in words for w in ((x,) if "\n" not in x or not self.lines else re.split("(\n)", x))]

    @functools.cached_property
    def own_mark(self) -> tuple[bytes, float]:
        return np.array([self.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes(), self.unknown_score

    @functools.cached_property
    def lines(self) -> bool:
        return not any("\n" in self.pieces[i] for i in self.scores)

    def decode(self, ids: np.ndarray) -> str:
        out, pending = [], bytearray()
        for i in ids.tolist():
            if i in self.bytes_of:
                pending.append(self.bytes_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            if i not in self.silent:
                piece = self.pieces[i] if out else self.pieces[i].removeprefix(SPACE)
                out.append(piece.replace(SPACE, " "))
        out.append(pending.decode(errors="replace"))
        return "".join(out)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, score for every row of docs (doc_id, text).

    Null and empty texts have no ids and score 0. Repeated rows give repeated results; a null doc_id is kept; an empty table
    gives no rows; further columns are ignored. Texts are read whole.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = loaded(model)
        found = [pieces.encode(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0] + [len(ids) for ids, _ in found], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<i4"), *(x for x, _ in found)])))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), ids, pa.array([s for _, s in found], pa.float64())],
            ["doc_id", "n_tokens", "ids", "score"],
        )

    return map_batches(docs.select("doc_id", "text"), one, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded (doc_id, ids). Null ids give an empty text. Bytes that are no UTF-8 become replacement marks."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = loaded(model)
        texts = [pieces.decode(np.array(x or [], dtype="<i4")) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), one, "doc_id bigint, text string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian ids), score and whether decoding the ids gives the text back."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = loaded(model)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [pieces.encode(t) for t in texts]
        same = [pieces.decode(ids) == t for (ids, _), t in zip(found, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(ids) for ids, _ in found], pa.int64()),
                pa.array([zlib.crc32(ids.tobytes()) for ids, _ in found], pa.int64()),
                pa.array([s for _, s in found], pa.float64()),
                pa.array(same, pa.bool_()),
            ],
            ["doc_id", "n_tokens", "ids_crc32", "score", "round_trip"],
        )

    return map_batches(docs.select("doc_id", "text"), one, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, score double, round_trip boolean")
