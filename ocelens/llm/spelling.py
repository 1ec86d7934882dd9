"""Words that are one edit apart, by pivotal grams (operator 11).

The bigrams of all words are put in one order, rare ones first. One edit spoils two
neighbouring bigrams at most, so of two words that are near, the one whose three rarest
bigrams end earlier keeps one of any two disjoint bigrams among them at its place, or next
to it, in the other word, and there that bigram is among the three rarest too. So each word
names two pivots, the disjoint pair of least total frequency among its three rarest
bigrams (dynamic programming over places), and pivots are joined with the rarest bigrams
of all words. The position limit is exact: the edit is behind the kept bigram or before
it, so the bigram has its old place from the start of the word, with the same characters
before it, or its old place from the end, with the same behind it. The join is on that
side of the word. What meets is verified on the whole words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.llm.arrow import map_arrow, slices, texts
from ocelens.session import materialise

#: Classes of bigrams whose frequencies order them; the broadcast has one number for each.
GRAM_CLASSES = 1 << 16
#: Distinct words that a task counts before it passes the counts on.
_COUNTED = 200_000
#: A prefix of three bigrams, and two of them that are disjoint, need four characters.
_SHORTEST = 4
#: A side of a word with so many characters is short; the end that an edit may spare then.
_SHORT, _END = 4, 3


def vocabulary(docs: DataFrame, pattern: str, shortest: int = _SHORTEST, least: int = 1, planted: int = 0) -> DataFrame:
    """(word, n): the words of all texts with how often they occur, from ``shortest`` characters and ``least`` times.

    Columns read: text, and doc_id if errors are planted. Words are the matches of
    ``pattern`` after lower-casing A-Z alone. If ``planted`` is not 0, one character is deleted from the
    words of a document for which it divides h, the CRC-32 of ``<doc_id>:<word>``: the one
    at h modulo the length. Null texts have no words; a null doc_id reads as the empty string.
    Occurrences are counted in tasks first, so a frequent word is one row of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, "text"):
            for doc, text in zip(part.column("doc").to_pylist(), texts(part, "text"), strict=True):
                # bytes are lower-cased within ASCII only
                found = find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if planted:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode("utf-8", "surrogatepass"), seed)
                        if h % planted == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            total[word] += n
                else:
                    total.update(w for w in found if len(w) >= shortest)
                if len(total) >= _COUNTED:
                    yield counted()
                    total.clear()
        yield counted()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if planted else F.lit("")
    source = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text"))
    parts = map_arrow(source, run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _gram_class(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_CLASSES)).cast("int")


def _grams(word: str) -> Column:
    """(gram, at) of the bigrams of a column of words."""
    places = F.sequence(F.lit(0), F.char_length(word) - 2)
    return F.transform(places, lambda at: F.struct(F.substring(F.col(word), at + 1, 2).alias("gram"), at.alias("at")))


def choose_pivots(prefix: list[tuple[int, int]], count: int = 2, width: int = 2) -> list[int]:
    """Places of ``count`` disjoint grams of least total frequency; ``prefix`` has (place, frequency).

    best[k] is the cheapest choice of k grams that end before the current place.
    """
    ordered = sorted(prefix)
    reach: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, (at, frequency) in enumerate(ordered):
        free = max((j + 1 for j in range(i) if ordered[j][0] + width <= at), default=0)
        before = reach[free - 1] if free else [(0, ())] + [None] * count
        current = list(reach[i - 1]) if i else [(0, ())] + [None] * count
        for k in range(1, count + 1):
            if (shorter := before[k - 1]) is not None:
                one = (shorter[0] + frequency, (*shorter[1], at))
                if current[k] is None or one < current[k]:
                    current[k] = one
        reach.append(current)
    if not reach or reach[-1][count] is None:
        raise ValueError("no such disjoint grams")
    return list(reach[-1][count][1])


def _letters(word: str) -> int:
    """A bit for each character in the word, as a signed number; one edit changes two bits at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits - (bits >> 63 << 64)


def _sides(word: str, at: int, tails: tuple[int, ...]) -> set[str]:
    """Names of the parts of a word that an edit leaves alone which spares the bigram at ``at``.

    Behind the bigram: it stands with all before it. If that is short, the edit either
    spares the last characters, which then are named too, or all but the last. Before the
    bigram likewise. ``tails`` are the lengths that the spoilt end may have in this word.
    """
    size, end = len(word), at + 2
    out = set()
    if end > _SHORT:
        out.add(f"<{word[:end]}")
    else:
        out.add(f"<{word[:end]} {word[-_END:]}")
        out |= {f"<{word[: max(end, size - tail)]}|" for tail in tails}
    if size - at > _SHORT:
        out.add(f">{word[at:]}")
    else:
        out.add(f">{word[:_END]} {word[at:]}")
        out |= {f">|{word[min(at, tail) :]}" for tail in tails}
    return out


def _selected(words: DataFrame) -> DataFrame:
    """(word, side, pivot, held, letters): the sides of the rarest bigrams of every word.

    ``pivot`` marks the sides of its pivots, ``held`` those that pivots of other words are
    joined with; ``letters`` tells which characters the word has.
    """
    spark = words.sparkSession
    counts = words.select(F.explode(_grams("word")).alias("g")).groupBy(_gram_class(F.col("g.gram")).alias("c")).agg(F.count("*").alias("n"))
    frequency = np.zeros(GRAM_CLASSES, np.int64)
    for c, n in counts.toLocalIterator():  # at most GRAM_CLASSES rows
        frequency[c] = n
    shared = spark.sparkContext.broadcast(frequency)

    def run(batches):
        table = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for word, classes in zip(batch.column("word").to_pylist(), batch.column("classes"), strict=True):
                # the order of bigrams is by frequency of the class and then by name
                numbers = table[classes.values.to_numpy()].tolist()
                keyed = sorted((n, word[at : at + 2], at) for at, n in enumerate(numbers))
                last = keyed[2][:2]
                # all places of the last bigram belong to the prefix
                prefix = [at for n, gram, at in keyed if (n, gram) <= last]
                pivots = choose_pivots([(at, n) for n, _, at in keyed[:3]])
                asked = set().union(*(_sides(word, at, (_END,)) for at in pivots))
                held = set().union(*(_sides(word, at, (_END - 1, _END, _END + 1)) for at in prefix))
                letters = _letters(word)
                for side in asked | held:
                    for column, value in zip(out, (word, side, side in asked, side in held, letters), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["word", "side", "pivot", "held", "letters"])

    classed = words.select("word", F.transform(_grams("word"), lambda g: _gram_class(g["gram"])).alias("classes"))
    return map_arrow(classed, run, "word string, side string, pivot boolean, held boolean, letters long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs, both ways, that differ by exactly one inserted, deleted or replaced character.

    Columns read: word, of four characters or more (an error otherwise). Nulls and repeated
    rows count for nothing; an empty table has no pairs. Every pair is verified on the words.
    """
    distinct = words.select(F.col("word").cast("string").alias("word")).where("word is not null").distinct()
    checked = distinct.select(F.when(F.char_length("word") >= _SHORTEST, F.col("word")).otherwise(F.raise_error(F.lit(f"a word has fewer than {_SHORTEST} characters"))).alias("word"))
    rarest = materialise(_selected(materialise(checked)))
    asked, held = ([F.col("word").alias(f"_{s}"), "side", F.col("letters").alias(f"_l{s}")] for s in "ab")
    met = rarest.where("pivot").select(*asked).join(rarest.where("held").select(*held), "side")
    # cheap tests first: a letter or two apart, and a length
    met = met.where("_a <> _b and bit_count(_la ^ _lb) <= 2 and abs(char_length(_a) - char_length(_b)) <= 1 and levenshtein(_a, _b, 1) = 1")
    pairs = materialise(met.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct())
    return pairs.select(F.col("_a").alias("word"), F.col("_b").alias("near")).unionByName(pairs.select(F.col("_b").alias("word"), F.col("_a").alias("near")))


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word with its more frequent spelling.

    Columns read: word, n (one row per word). The form is the near word that occurs most
    often (ties: the smallest in code-point order) if it occurs at least ``times`` (2 or
    more) as often as the word, else null. The root is where following forms ends, the
    word itself if it has none. A word without near words has n_near 0.
    """
    if times < 2:
        raise ValueError("forms have to be more frequent than their words")
    counted = materialise(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_words(counted)
    other = counted.select(F.col("word").alias("near"), F.col("n").alias("_n"))
    # the largest n, and of those the smallest word
    best = pairs.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("_n"), "near")).alias("_best"))
    joined = counted.join(best, "word", "left")
    fits = -F.col("_best._n") >= F.col("n") * times
    rows = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("_best.near")).alias("form"), F.when(fits, -F.col("_best._n")).alias("form_n"),
    ))
    # every step multiplies n, so a few doublings reach the end
    hops = materialise(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = hops.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        longer = hops.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved"))
        hops = materialise(longer)
        if hops.where("_moved").isEmpty():
            break
        hops = hops.drop("_moved")
    return rows.join(hops.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
