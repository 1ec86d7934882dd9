"""SentencePiece encoding and decoding for merge-type vocabularies (operator 12).

A text starts as its characters. Adjacent symbols whose join is a piece stand on an agenda
ordered by the score of that piece, the leftmost first among equals; the best pair is
joined, its new neighbours go on the agenda, and entries whose symbols have changed since
are passed over. What is left and is no piece falls back to its bytes.

Two characters that stand side by side in no piece are never joined, so a text may be cut
between them. Cuts recur, so the ids of each are remembered (``encoders``); the agenda runs
once for a cut, and the cuts that are new in an Arrow batch are checked against the
sentencepiece library before the batch is given back.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.llm.arrow import int_lists, map_arrow, map_slices, texts
from ocelens.llm.encoders import CutEncoder, shared

BLANK = "▁"  # stands for a space
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNKNOWN_SURFACE = " ⁇ "
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_OTHERS = "".join(chr(c) for c in range(128) if not chr(c).isalpha()) + BLANK


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


class PieceModel:
    """The pieces and settings of a model file; refuses what the agenda does not cover."""

    def __init__(self, spec: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(spec):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append((one[1].decode(), float(np.frombuffer(one.get(2, b"\0" * 4), "<f4")[0]), one.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.dummy_prefix, self.trims = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        refused = {
            "is not of the merge type": trainer.get(3, 1) != 2,
            "has no byte fallback": not trainer.get(35, 0),
            "maps characters": bool(normalizer.get(2)),
            "does not escape spaces, or puts them last": not normalizer.get(5, 1) or bool(trainer.get(24, 0)),
            "has user-defined or unused pieces": any(kind not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for _, _, kind in self.pieces),
        }
        if any(refused.values()):
            raise ValueError("the vocabulary " + " and ".join(why for why, holds in refused.items() if holds))


class PieceEncoder(CutEncoder):
    """Encoder and decoder for the content of a model file."""

    def __init__(self, spec: bytes):
        model = PieceModel(spec)
        self._ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind == _NORMAL}
        self._costs = {piece: -score for piece, score, kind in model.pieces if kind == _NORMAL}
        self._bytes = [0] * 256
        for i, (piece, _, kind) in enumerate(model.pieces):
            if kind == _BYTE:
                self._bytes[int(piece[1:-1], 16)] = i
        self._dummy_prefix, self._trims = model.dummy_prefix, model.trims
        self._surface = [self._surface_of(*p) for p in model.pieces]
        self._kinds = [kind for _, _, kind in model.pieces]
        self._library = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self._fresh: list[tuple[str, bytes]] = []
        joined = {piece[k : k + 2] for piece in self._ids for k in range(len(piece) - 1)}
        self._apart = next((c for c in "\n\t " if not any(c in pair for pair in joined)), None)
        super().__init__(re.compile(_sure_cuts(joined)))

    @staticmethod
    def _surface_of(piece: str, _: float, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {_CONTROL: "", _UNKNOWN: _UNKNOWN_SURFACE}.get(kind, piece.replace(BLANK, " ")).encode()

    def encode(self, text: str) -> bytes:
        if self._trims:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return b""
        return super().encode((BLANK if self._dummy_prefix else "") + text.replace(" ", BLANK))

    def learn(self, cuts: list[str]) -> list[bytes]:
        found = [np.array(self.merged(cut), "<u4").tobytes() for cut in cuts]
        self._fresh += zip(cuts, found, strict=True)
        return found

    def merged(self, symbols: str) -> list[int]:
        """Ids of a normalised text by the agenda of adjacent pairs."""
        ids, costs = self._ids, self._costs
        if len(symbols) > 1 and symbols not in ids or len(symbols) > 2:
            symbols = self._join_by_score(list(symbols), costs)
        out: list[int] = []
        for symbol in symbols if isinstance(symbols, list) else [symbols]:
            if (known := ids.get(symbol)) is not None:
                out.append(known)
            else:
                out += [self._bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return out

    @staticmethod
    def _join_by_score(symbols: list[str], costs: dict[str, float]) -> list[str]:
        n = len(symbols)
        agenda = []
        for left in range(n - 1):
            if (cost := costs.get(symbols[left] + symbols[left + 1])) is not None:
                agenda.append((cost, left, left + 1, 2))
        if not agenda:
            return symbols
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of them has been joined since
            symbols[left], symbols[right] = one, _ = a + b, ""
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if (cost := costs.get(one + symbols[beyond])) is not None:
                    heappush(agenda, (cost, left, beyond, size + len(symbols[beyond])))
            if (previous := before[left]) >= 0 and (cost := costs.get(symbols[previous] + one)) is not None:
                heappush(agenda, (cost, previous, left, size + len(symbols[previous])))
        return [s for s in symbols if s]

    def check(self) -> None:
        """Compare what was learnt since the last call with the library; a difference fails the task."""
        fresh, self._fresh = self._fresh, []
        if self._apart is None:
            return
        lead = self._library.encode(self._apart)
        found = self._library.encode([self._apart + cut.replace(BLANK, " ") for cut, _ in fresh], num_threads=1)
        for (cut, ids), library in zip(fresh, found, strict=True):
            if ids != np.array(library[len(lead) :], "<u4").tobytes():
                raise ValueError(f"the library encodes {cut!r} as {library[len(lead):]}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library puts it; bytes that are no character become U+FFFD each."""
        parts = [self._surface[i] for i in ids]
        first = next((k for k, i in enumerate(ids) if self._kinds[i] != _CONTROL), None)
        if first is not None and self._kinds[ids[first]] == _NORMAL and (self._dummy_prefix or self._trims):
            parts[first] = parts[first].removeprefix(b" ")
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return _decoded_by_character(b"".join(parts))


def _decoded_by_character(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def _sure_cuts(joined: set[str]) -> str:
    """A pattern whose matches, side by side, are a text; no pair in ``joined`` lies across two."""
    if any(pair[1] == BLANK and pair[0] != BLANK for pair in joined):
        return r"(?s).+"

    def never_after(firsts: str) -> str:
        return re.escape("".join(c for c in _OTHERS if not any(f + c in joined for f in firsts)))

    alone = "".join(c for c in _OTHERS if c != BLANK and not any(pair[0] == c for pair in joined))
    some = [f"{BLANK}*+[{re.escape(alone)}]"] if alone else []
    for kind in (_LETTERS, string.digits):
        if ends := never_after(kind):
            # a single digit where digits never join, else as many as there are
            repeat = "" if kind == string.digits and "0" in ends else "++"
            some.append(f"{BLANK}*+[{kind}]{repeat}(?=[{ends}])")
    return "|".join([*some, f"{BLANK}*+[^{BLANK}]+", f"{BLANK}+"])


def _encoder(spark, path: str):
    return shared(spark, path, PieceEncoder)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text, without begin and end, by the model file at ``path``.

    Columns read: doc_id, text. A null or empty text has no ids; the strings of control
    pieces are ordinary text; a repeated row gives a repeated result; a null doc_id stays
    null; an empty table gives none. A text of any length is cut and joined as a whole.
    """
    get = _encoder(docs.sparkSession, path)

    def make():
        encoder = get()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = int_lists([encoder.encode(t) for t in texts(part, "text")])
            encoder.check()
            return pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

        return step

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", make, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text that their ``ids`` stand for, in place of the ids.

    Null ids give a null text, no ids an empty one; an unknown id fails the job.
    """
    get = _encoder(encoded.sparkSession, path)
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = get()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [None if not row.is_valid else coder.decode(row.values.to_numpy(zero_copy_only=False).tolist()) for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(found, pa.string())], schema.names)

    return map_arrow(encoded.select(*rest, "ids"), run, schema)
