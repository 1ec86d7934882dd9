"""Byte-level BPE by backtracking over longest matches (operator 1).

Bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the
longest token at every position of a piece in one pass. The encoder walks from longest
match to longest match. A step is allowed only if the token and its left neighbour are
compatible, i.e. merging would not join across their border; if no prefix of the match is
compatible, it steps back one token and never tries that end again. Every position is
given up once at most, so the work is linear in the piece, and the tokens are exactly
those of applying the merges by rank.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.llm.arrow import int_lists, map_arrow, map_slices, texts
from ocelens.llm.encoders import CutEncoder, shared

#: Remembered answers about neighbours, per worker.
PAIRS = 1_000_000


class ByteBpe(CutEncoder):
    """Encoder and decoder for a vocabulary file of ranks: lines of base64 token and rank."""

    def __init__(self, spec: bytes, pattern: str):
        super().__init__(regex.compile(pattern))
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in spec.splitlines() if line)}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._length = {rank: len(token) for token, rank in ranks.items()}
        self._joined: dict[tuple[int, int], int] = {}  # neighbours that a merge turns into one token
        self._parts: dict[int, tuple[int, int]] = {}  # the last merge of a token
        self._known: dict[tuple[int, int], bool] = {}
        self._shorter = {rank: self._longest_prefix(token) for token, rank in ranks.items()}
        self._split_tokens()
        self._known.clear()
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for rank, token in self.tokens.items():
            if len(token) == 1 or rank in self._parts:
                self._automaton.add_word(token.decode("latin-1"), rank)
        self._automaton.make_automaton()

    def _longest_prefix(self, token: bytes) -> int | None:
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _split_tokens(self) -> None:
        """By rank, so that the merges below a token are known when its own is looked for."""
        for rank in sorted(self.tokens):
            token, left = self.tokens[rank], self._shorter[rank]
            while left is not None:
                right = self.ranks.get(token[self._length[left] :])
                if left < rank and right is not None and right < rank and self._meet(left, right):
                    self._joined[left, right] = rank
                    self._parts[rank] = (left, right)
                    break
                left = self._shorter[left]
        for rank, shorter in self._shorter.items():  # tokens that no merge makes are no step either
            while shorter is not None and shorter not in self._parts and self._length[shorter] > 1:
                shorter = self._shorter[shorter]
            self._shorter[rank] = shorter

    def _meet(self, left: int, right: int) -> bool:
        """Whether the two can stand side by side after all merges.

        Undo the merges from the border outwards, the later one first. Each pair of
        tokens that ever met at the border must not have been joined before the merges
        that are already undone took place.
        """
        before = float("inf")
        while True:
            if self._joined.get((left, right), before) < before:
                return False
            if left > right:
                if left not in self._parts:
                    if right not in self._parts:
                        return True
                    before, right = right + 1, self._parts[right][0]
                else:
                    before, left = left, self._parts[left][1]
            elif right in self._parts:
                before, right = right + 1, self._parts[right][0]
            elif left in self._parts:
                before, left = left, self._parts[left][1]
            else:
                return True

    def _compatible(self, left: int, right: int) -> bool:
        answer = self._known.get((left, right))
        if answer is None:
            if len(self._known) >= PAIRS:
                self._known.clear()
            answer = self._known[left, right] = self._meet(left, right)
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is a token is that token."""
        if not piece:
            return []
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        length, shorter = self._length, self._shorter
        longest = [0] * len(piece)
        for end, rank in self._automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends come in order, so the longest stays
        found: list[int] = []
        open_ends = bytearray(b"\1") * (len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if open_ends[end] and (not found or self._compatible(found[-1], token)):
                found.append(token)
                at = end
                if at == len(piece):
                    return found
                token = longest[at]
            elif (less := shorter[token]) is not None:
                token = less
            else:
                open_ends[at] = 0
                token = found.pop()
                at -= length[token]

    def learn(self, cuts: list[str]) -> list[bytes]:
        return [np.asarray(self.encode_piece(c.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes() for c in cuts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _encoder(spark, path: str, pattern: str):
    def build(spec: bytes) -> ByteBpe:
        return ByteBpe(spec, pattern)

    build.__qualname__ = f"ByteBpe {pattern}"
    return shared(spark, path, build)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of every whole text, each match of ``pattern`` by itself.

    Columns read: doc_id, text. A null or empty text has no ids; special strings are
    ordinary text; a repeated row gives a repeated result; a null doc_id stays null. What
    the pattern leaves unmatched has no ids, as in the library.
    """
    get = _encoder(docs.sparkSession, path, pattern)

    def make():
        encoder = get()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = int_lists([encoder.encode(t) for t in texts(part, "text")])
            return pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

        return step

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", make, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows with ``decoded``, the bytes that their ``ids`` stand for, in place of the ids.

    Null ids give null bytes, no ids give no bytes, an unknown id fails the job.
    """
    get = _encoder(encoded.sparkSession, path, pattern)
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        coder = get()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [None if not row.is_valid else coder.decode(row.values.to_numpy(zero_copy_only=False).tolist()) for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(found, pa.binary())], schema.names)

    return map_arrow(encoded.select(*rest, "ids"), run, schema)
