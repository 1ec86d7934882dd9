"""Line-first cleaning of documents (operator 4).

Each line is judged by itself for its punctuation, as navigation and as boilerplate; lines
that fail are removed, and a document that loses too much of its text by that is rejected.
A few counts over the whole text reject documents before any line is looked at. A document
is judged by itself in one pass, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.llm.arrow import map_arrow, slices, texts
from ocelens.llm.words import WORD

_SYMBOL = re.compile(r"[#*$%&|<>]")
_END = re.compile(r"[.!?:;\"'”’»…)\]][\x20\x09-\x0D]*$")
_PILED = re.compile(r"[!?]{2,}")
_BOILERPLATE = re.compile(
    r"all rights reserved|(?:released|licensed) under the|is licensed under|copyright (?:\(c\)|©|[12][0-9]{3})"
    r"|lorem ipsum|(?:enable|requires?) javascript|(?:we|site) uses? cookies|accept (?:all )?cookies"
    r"|terms of (?:use|service)|privacy policy|click here|sign (?:in|up) (?:to|with)|subscribe to our|read more",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; the defaults are meant for prose in languages with sentence punctuation."""

    min_words: int = 50
    max_repeated: float = 0.5  # share of words in repeated 3-word windows
    short_line: int = 5  # words under which a line has to end like a sentence
    max_symbols: float = 0.1  # share of a line's word characters that are symbols
    max_piled: float = 0.2  # piled-up marks for each word of a line
    max_bars: int = 3  # bars in a line that is a menu
    max_boilerplate: int = 30  # words up to which a phrase makes the whole line boilerplate
    max_lost: float = 0.4  # share of word characters that may go with the removed lines


def line_fails(line: str, rules: LineRules) -> bool:
    """Whether one line with a word in it is removed."""
    found = WORD.findall(line)
    chars = sum(map(len, found))
    if line.count("|") + line.count("»") + line.count("•") >= rules.max_bars:
        return True  # navigation
    if len(found) < rules.short_line and not _END.search(line):
        return True  # a label or button
    if len(_PILED.findall(line)) > rules.max_piled * len(found) or len(_SYMBOL.findall(line)) > rules.max_symbols * chars:
        return True  # punctuation
    return len(found) <= rules.max_boilerplate and bool(_BOILERPLATE.search(line))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which occurs twice or more, the first included."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    windows = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
    if len(seen) < 2_000_000:  # three numbers fit in one
        n = len(seen)
        _, at, counts = np.unique((windows[:, 0] * n + windows[:, 1]) * n + windows[:, 2], return_inverse=True, return_counts=True)
    else:
        _, at, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    twice = counts[at.ravel()] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def judge(text: str, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bad_lines, cleaned)."""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    lines = text.split("\n")
    solid = [line for line in lines if WORD.search(line)]
    repeated = repeated_words(words)
    failed = len(words) < rules.min_words or repeated > rules.max_repeated * len(words)
    bad = {line for line in set(solid) if line_fails(line, rules)}
    lost = sum(sum(map(len, WORD.findall(line))) for line in solid if line in bad)
    kept = not failed and lost <= rules.max_lost * chars
    cleaned = "\n".join(line for line in lines if line not in bad) if bad else text
    counts = (len(words), chars, len(_SYMBOL.findall(text)), len(solid) - len(set(solid)), repeated)
    return (*counts, failed, kept, len(solid), sum(line in bad for line in solid), cleaned)


_MEASURES = (
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("n_lines", T.LongType(), pa.int64()),
    ("n_bad_lines", T.LongType(), pa.int64()),
    ("cleaned", T.StringType(), pa.string()),
)


def assess(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), rules: LineRules | None = None, cleaned: bool = True) -> DataFrame:
    """The columns of ``carry`` with the measures, the verdict and the cleaned text of every document.

    Columns read: text and ``carry``. A null or empty text has no words and so fails;
    a repeated row gives a repeated result. Words are runs without ASCII white space.
    Cleaning removes failed lines with their line break and changes nothing else.
    """
    rules = rules or LineRules()
    measures = _MEASURES if cleaned else _MEASURES[:-1]
    schema = T.StructType([*[docs.schema[c] for c in carry], *[T.StructField(n, kind) for n, kind, _ in measures]])
    source = docs.select(*carry, F.col("text").cast("string").alias("_text"))

    def run(batches):
        for part in slices(batches, "_text"):
            found = [judge(t, rules)[: len(measures)] for t in texts(part, "_text")]
            columns = [pa.array(v, kind) for v, (_, _, kind) in zip(zip(*found, strict=True), measures, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *columns], schema.names)

    return map_arrow(source, run, schema)


def clean(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """The documents that are kept, in their own columns, with the cleaned text.

    ``n_chars``, where there is one, follows the new text.
    """
    carry = tuple(c for c in docs.columns if c != "text")
    inner = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], "text")
    kept = assess(inner, tuple(f"_c{i}" for i in range(len(carry))), rules).where("kept")
    return restored(docs, kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("cleaned").alias("text")))


def restored(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` in the column order of ``docs``, with n_chars counted anew."""
    out: dict[str, Callable] = {c: F.col(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[column.alias(c) for c, column in out.items()])
