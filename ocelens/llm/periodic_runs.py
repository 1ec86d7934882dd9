"""Runs of periodic text by maximal pairs (operator 13).

A run of period q that covers length words is a maximal pair of equal stretches: the
length - q words from its start are those from q words later on, and neither the words
before nor the words behind the two stretches are equal. The suffixes of the texts are
sorted by prefix doubling, and the tree of LCP intervals is walked bottom-up. A node keeps
the places of its suffixes in order, each with its class, the word to its left. When a
child joins, each of its places (each of the node's, if these are fewer) meets the nearest
places of the other side: their suffixes differ right behind the LCP, so if their classes
differ they are a maximal pair, and if their distance fits the length, that pair is a run
as it stands. Places further off need no look: one in between makes the period smaller.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.llm.arrow import map_arrow, slices, texts
from ocelens.llm.words import WORD

#: Bytes of text whose suffixes are sorted together; a longer text stands alone.
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class RunRules:
    """A run covers ``length`` words at least and ``times`` (2 or more) of its period."""

    length: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 2 or self.length < 1:
            raise ValueError("a run has two periods and one word at least")

    @property
    def least_equal(self) -> int:
        """The shortest pair that can be a run."""
        return min(max((self.times - 1) * q, self.length - q) for q in range(1, self.length + 1))


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes in order, and for each its group among those of ``depth`` equal symbols.

    The last symbol, and some symbol after each repeated one, must be unique. A group is
    named by the place in the order where it begins; -1 stands for a suffix alone in its group.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    open_, base, keys, width = order, np.zeros(n, np.int64), symbols[order], 1
    groups = np.full(n, -1, np.int64)
    while True:
        # open_ is sorted by its old groups and then by its keys
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        fresh = np.concatenate(([True], base[1:] != base[:-1]))
        index = np.arange(len(open_))
        place = base + index - np.maximum.accumulate(np.where(fresh, index, 0))
        order[place] = open_
        rank[open_] = at = place[np.maximum.accumulate(np.where(first, index, 0))]
        alone = first & np.concatenate((first[1:], [True]))
        open_, base = open_[~alone], at[~alone]
        if width <= depth:
            groups[:] = -1
            groups[open_] = base
        if not len(open_):
            return order, groups
        keys = base * (n + 1) + rank[open_ + width]
        by = np.argsort(keys, kind="stable")
        open_, base, keys = open_[by], base[by], keys[by]
        width *= 2


def _common(symbols: list[int], order: list[int], place: np.ndarray, groups: np.ndarray) -> dict[int, int]:
    """place in the order -> length of the prefix shared with the suffix before it in its group."""
    out, length, last = {}, 0, -2
    for i in np.flatnonzero((groups >= 0) & (place > groups)).tolist():
        at = int(place[i])
        j = order[at - 1]
        length = length - 1 if i == last + 1 and length else 0
        while symbols[i + length] == symbols[j + length]:
            length += 1
        out[at], last = length, i
    return out


def maximal_pairs(symbols: np.ndarray, rules: RunRules) -> dict[tuple[int, int], int]:
    """(start, stop) -> period of all runs in a row of numbers.

    After each stretch that may hold runs comes a number that is nowhere else; no run holds it.
    """
    order, groups = sorted_suffixes(symbols, 4 if rules.least_equal >= 4 else 1)
    place = np.empty(len(symbols), np.int64)
    place[order] = np.arange(len(symbols))
    plain, suffixes = symbols.tolist(), order.tolist()
    shared = _common(plain, suffixes, place, groups)
    found: dict[tuple[int, int], int] = {}
    least, times = rules.least_equal, rules.times - 1

    def pair(x: int, y: int, equal: int) -> None:
        period = y - x
        if period * times <= equal and equal + period >= rules.length and (x == 0 or plain[x - 1] != plain[y - 1]):
            key = (x, y + equal)
            if found.get(key, period) >= period:
                found[key] = period

    def join(node: list[int], child: list[int], equal: int) -> list[int]:
        """The places of both, in order; the fewer look for their neighbours among the more."""
        if len(node) < len(child):
            node, child = child, node
        for x in child:
            k = bisect(node, x)
            if k:
                pair(node[k - 1], x, equal)
            if k < len(node):
                pair(x, node[k], equal)
        for x in child:
            insort(node, x)
        return node

    stack: list[tuple[int, list[int]]] = []
    done: list[int] = []
    last = -2
    for at in sorted(shared):
        equal = shared[at]
        if equal < least or at != last + 1:
            while stack:
                length, node = stack.pop()
                done = join(node, done, length)
            done = [suffixes[at - 1]]
        if equal >= least:
            while stack and stack[-1][0] > equal:
                length, node = stack.pop()
                done = join(node, done, length)
            if stack and stack[-1][0] == equal:
                done = join(stack.pop()[1], done, equal)
            stack.append((equal, done))
        done, last = [suffixes[at]], at
    while stack:
        length, node = stack.pop()
        done = join(node, done, length)
    return found


def runs_of(documents: list[list[str]], rules: RunRules) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    found = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in documents]
    kinds = len(numbers) + 1
    # a word counts as equal within its own document only; the end of each is unique
    symbols = np.concatenate([np.append(own, kinds - 1) + kinds * d for d, own in enumerate(found)] or [np.empty(0, np.int64)])
    starts = np.cumsum([0] + [len(words) + 1 for words in documents])
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if len(symbols):
        for (start, stop), period in maximal_pairs(symbols, rules).items():
            d = int(np.searchsorted(starts, start, "right")) - 1
            out[d].append((start - int(starts[d]), stop - start, period))
    for rows in out:
        rows.sort(key=lambda run: (run[0], run[2]))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join(word for word, k in zip(words, kept.tolist(), strict=True) if k)


def runs(docs: DataFrame, rules: RunRules | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of ``docs``.

    Columns read: doc_id, text. ``runs`` has (start, length, period), counted in words, by
    start and period; ``collapsed`` has the words of the text without those that repeat
    the first period of a run, joined by one space. Words are runs without ASCII white
    space. A null, empty or blank text has no run and is collapsed to an empty one; a
    repeated row gives a repeated result; a null doc_id stays null; an empty table gives
    none. A text of any length is searched as a whole, and no document sees another.
    """
    rules = rules or RunRules()
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run_type)),
        T.StructField("collapsed", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _TOGETHER):
            documents = [WORD.findall(t) for t in texts(part, "text")]
            found = runs_of(documents, rules)
            flat = np.array([r for rows in found for r in rows], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            kept = [collapsed(words, rows) for words, rows in zip(documents, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(w) for w in documents], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(kept, pa.string())],
                schema.names,
            )

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
