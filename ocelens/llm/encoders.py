"""Whole texts to token ids, one encoder per Python worker.

Natural text repeats its words, so an encoder cuts a text where the tokenizer is sure to
cut it too, remembers the ids of every cut, and joins them. The memory is bounded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import filterfalse, islice

import numpy as np
from pyspark.sql import SparkSession

#: Remembered cuts per worker in each of two generations (some 120 MB each), and cuts of a
#: long text taken at a time.
MEMORY, AT_A_TIME = 600_000, 200_000

#: A private-use character that separates cuts in one call; a cut that holds it goes alone.
_BETWEEN = "\ue000"

# Unicode white space as the tokenizers see it: Python's \s also has the separators 1C-1F.
_SPACE, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# Runs of letters, digits or marks that both families end where an ASCII character of another
# kind begins. Beyond ASCII a combining mark could join them; an apostrophe can begin a suffix.
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[^A-Za-z\x80-\U0010ffff])"
_DIGITS = r"[0-9]++(?=[^0-9\x80-\U0010ffff])"
_MARKS = r"[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\x09-\x0d ])"
_ONE_KIND = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+)")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d|"
_WORD_ENDS = f"{_LETTERS}|[0-9](?=[\x00-\x7f])|{_MARKS}|{_SOLID}+"


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class CutEncoder:
    """Ids of a text as little-endian 32-bit integers, cut by ``pattern`` (a compiled regex)."""

    def __init__(self, pattern):
        self._pattern = pattern
        self._memory: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def learn(self, cuts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        if len(text) < 4 * AT_A_TIME:
            return self._join(self._pattern.findall(text))
        found = (m.group() for m in self._pattern.finditer(text))
        return b"".join(self._join(part) for part in iter(lambda: list(islice(found, AT_A_TIME)), []))

    def _join(self, cuts: list[str]) -> bytes:
        """What is met again moves to the young generation; when that is full, the old one goes."""
        fresh = set(filterfalse(self._memory.__contains__, cuts))
        if fresh:
            if len(self._memory) + len(fresh) > MEMORY:
                self._older, self._memory = self._memory, {}
                fresh = set(cuts)
            missing = [c for c in fresh if c not in self._older]
            self._memory.update((c, self._older[c]) for c in fresh if c in self._older)
            self._memory.update(zip(missing, self.learn(missing), strict=True))
        return b"".join(map(self._memory.__getitem__, cuts))


class LibraryEncoder(CutEncoder):
    """A file of the tokenizers library, special strings handled as its default.

    Two families of pre-tokenizers are cut into remembered parts: those that split at a
    space which then starts the next word, and those that drop white space and case. Any other
    file, and any text that holds a special string, goes through the library as a whole.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec.decode())
        self._model = self._tokenizer.model
        rules = json.loads(spec)
        self._special = [t["content"] for t in rules.get("added_tokens") or []]
        cut = _cut_rule(rules)
        self._whole = cut is None
        self._drops = cut == _WORD_ENDS
        # what stands between cuts that are encoded in one call, and its ids
        self._between = f" {_BETWEEN} " if self._drops else "\n"
        self._apart: list[int] = [] if self._whole else self._tokenizer.encode(self._between, add_special_tokens=False).ids
        super().__init__(re.compile(cut or r"(?s).+"))

    def learn(self, cuts: list[str]) -> list[bytes]:
        if self._whole:
            return self._by_pipeline(cuts)
        # a cut of one kind is one word to the tokenizer and can go straight to its model
        out = [self._by_model(c) if _ONE_KIND.fullmatch(c) else None for c in cuts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, ids in zip(rest, self._by_pipeline([cuts[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def _by_model(self, cut: str) -> bytes:
        if self._drops:
            cut = cut.lower()
        if not cut.isascii() or " " in cut:
            cut = "".join(map(_BYTE_LETTERS.__getitem__, cut.encode()))
        ids = [token.id for token in self._model.tokenize(cut)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_pipeline(self, cuts: list[str]) -> list[bytes]:
        if not self._apart or len(cuts) < 2 or any(map(self._blurs, cuts)):
            found = self._tokenizer.encode_batch_fast(cuts, add_special_tokens=False)
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]
        # one call for all cuts: white space keeps them and the separator apart
        text = self._between.join(cuts)
        ids = np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        here = np.ones(max(0, len(ids) - len(self._apart) + 1), dtype=bool)
        for k, one in enumerate(self._apart):
            here &= ids[k : k + len(here)] == one
        ends = np.flatnonzero(here)
        starts = [0, *(ends + len(self._apart)).tolist()]
        return [ids[a:b].tobytes() for a, b in zip(starts, [*ends.tolist(), len(ids)], strict=True)]

    def _blurs(self, cut: str) -> bool:
        """Whether the separator could not be told from the cut, or would join with it."""
        return _BETWEEN in cut if self._drops else cut[-1].isspace()

    def encode(self, text: str) -> bytes:
        if self._whole or any(s in text for s in self._special):
            return self.learn([text])[0]
        if self._drops:
            # Latin-1 texts are lower-cased the same way, letter by letter, by anyone
            with suppress(UnicodeEncodeError):
                text.encode("latin-1")
                text = text.lower()
        return super().encode(text)


def drops_white_space(spec: bytes) -> bool:
    """Whether the ids of a text depend on its white space only as a separator."""
    return _cut_rule(json.loads(spec)) == _WORD_ENDS


def _cut_rule(rules: dict) -> str | None:
    if any(rules.get(k) for k in ("truncation", "padding", "post_processor")) or rules["model"].get("dropout"):
        return None
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in rules.get("added_tokens") or []):
        return None
    normal, pre = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        # one space belongs to the word behind it, earlier white space is a token of its own
        return f" ?{_LETTERS}| ?{_DIGITS}| ?{_MARKS}| ?{_SOLID}+|{_SPACE}+(?!{_SOLID})|{_SPACE}"
    steps = (normal or {}).get("normalizers", [])
    shape = [s.get("type") for s in steps]
    parts = pre.get("pretokenizers", [])
    if (
        shape == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": "\\s+"}
        and steps[1].get("content") == " "
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert")
        and parts[0]["pattern"].get("Regex", "").removeprefix(_SUFFIXES) == r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
    ):
        return _WORD_ENDS
    return None


_loaded: dict[tuple[str, str], CutEncoder] = {}


def shared(spark: SparkSession, path: str, build: Callable[[bytes], CutEncoder]) -> Callable[[], CutEncoder]:
    """A function for tasks that gives the worker's encoder for the vocabulary at ``path``.

    The driver reads the file and broadcasts it; its size is that of a vocabulary,
    whatever the size of the data.
    """
    content = spark.sparkContext.broadcast(vocabulary(path))
    name = (build.__qualname__, hashlib.sha256(content.value).hexdigest())

    def get() -> CutEncoder:
        if name not in _loaded:
            _loaded[name] = build(content.value)
        return _loaded[name]

    return get


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def by_library(spark: SparkSession, path: str) -> Callable[[], CutEncoder]:
    return shared(spark, path, LibraryEncoder)


def pieces(ids: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of consecutive pieces of at most ``limit`` ids."""
    for start in range(0, len(ids), 4 * limit):
        yield start // 4, ids[start : start + 4 * limit]
