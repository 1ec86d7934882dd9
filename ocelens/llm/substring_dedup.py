"""Removal of passages that occur in an earlier document (operator 9).

A window is ``size`` consecutive words; a word goes if a window over it also starts in a
document with a smaller id. The steps:

1. Every window has an anchor, the smallest hash among its short grams. Equal windows have
   equal anchors, and a text has few of them, so the anchors that two documents share tell
   which windows can recur at all. Copies of a whole text are settled before that.
2. The hashes of those windows alone are grouped; windows that recur are confirmed and
   belong to their first document, where runs of them are the recurring passages.
3. Documents are dealt to shards. Each shard gets the passages whose anchors occur in its
   documents and compiles an Aho-Corasick automaton of phrases, half a window long, taken
   from the passages so closely that every window of a passage holds a whole phrase.
4. The shard's documents stream through the automaton. The windows round an occurrence of a
   phrase are looked up in a table of the passages' windows and compared as words, so what
   is removed was not compared as hashes alone.

A frequent passage reaches every shard once, a frequent anchor is only aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_rank
from ocelens.llm.arrow import map_arrow, slices, texts
from ocelens.llm.quality import restored
from ocelens.llm.words import WORD, mix, window_hashes, word_hashes
from ocelens.session import materialise

GRAM = 10
#: Text that one shard holds, about.
SHARD_BYTES = 8 << 20


def _anchored(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, anchor) of every window."""
    one = word_hashes(words)
    gram = min(GRAM, size)
    grams = window_hashes(one, gram)
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # the smallest of the grams in a window, by doubling
    span, least, width = size - gram + 1, grams, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(words) - size + 1
    return window_hashes(one, size), np.minimum(least[:n], least[span - width : span - width + n])


def _surveyed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_sha256, digest, n_words, words_sha256, anchors) of every row; short texts have no anchors."""

    def run(batches):
        for part in slices(batches, "text"):
            digests, counts, sums, anchors = [], [], [], []
            for text in texts(part, "text"):
                words = WORD.findall(text)
                joined = " ".join(words).encode("utf-8", "surrogatepass")
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                sums.append(hashlib.sha256(joined).hexdigest())
                counts.append(len(words))
                anchors.append(np.unique(_anchored(words, size)[1]).view(np.int64) if len(words) >= size else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_sha256"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                ["doc_id", "text_sha256", "digest", "n_words", "words_sha256", "anchors"],
            )

    return map_arrow(docs, run, "doc_id long, text_sha256 string, digest binary, n_words long, words_sha256 string, anchors array<long>")


def _recurring_windows(candidates: DataFrame, size: int) -> DataFrame:
    """(window, key): the windows of a text whose anchors recur, each once."""

    def run(batches):
        for part in slices(batches, "text"):
            windows, owners = [], []
            for key, text, anchors in zip(part.column("key").to_pylist(), texts(part, "text"), part.column("anchors"), strict=True):
                window, anchor = _anchored(WORD.findall(text), size)
                found = np.unique(window[np.isin(anchor.view(np.int64), anchors.values.to_numpy())])
                windows.append(found.view(np.int64))
                owners.append(np.full(len(found), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(windows)), pa.array(np.concatenate(owners))], ["window", "key"])

    return map_arrow(candidates.select("key", "text", "anchors"), run, "window long, key long")


def _runs(marked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def passages(candidates: DataFrame, first_windows: DataFrame, size: int) -> DataFrame:
    """(source, key, start, text, anchors): the recurring passages of the texts they first occur in."""

    def run(batches):
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, key, text, mine in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key")), texts(part, "text"), part.column("windows"), strict=True):
                words = WORD.findall(text)
                window, anchor = _anchored(words, size)
                for start, stop in _runs(np.isin(window.view(np.int64), mine.values.to_numpy())):
                    rows.append((doc, key, start, " ".join(words[start : stop + size - 1]), np.unique(anchor[start:stop]).view(np.int64)))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["source", "key", "start", "text", "anchors"])

    joined = candidates.select("doc_id", "key", "text").join(first_windows, "key")
    return map_arrow(joined.select("doc_id", "key", "text", "windows"), run, "source long, key long, start long, text string, anchors array<long>")


class PhraseAutomaton:
    """Finds in a text the windows of ``size`` words that passages of smaller ids hold.

    The automaton tells where phrases occur. A table of all windows of the passages, sorted
    by hash and source, answers for the windows round an occurrence, so a phrase of many
    passages costs no more than another; what it answers is compared as words.
    """

    def __init__(self, size: int):
        self._size = size
        self._phrase = max(1, size // 2)
        self._numbers: dict[str, int] = {}
        self._passages: list[np.ndarray] = []
        self._sources: list[int] = []
        self._phrases: set[tuple[int, ...]] = set()
        self._automaton = None

    def add(self, source: int, words: list[str]) -> None:
        if len(words) < self._size:
            return
        number = [self._numbers.setdefault(w, len(self._numbers) + 1) for w in words]
        self._passages.append(np.asarray(number, dtype=np.int64))
        self._sources.append(source)
        # phrases so close that each window holds one as a whole
        for at in range(0, len(words) - self._phrase + 1, self._size - self._phrase + 1):
            self._phrases.add(tuple(number[at : at + self._phrase]))

    def compile(self) -> None:
        if not self._passages:
            return
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for phrase in self._phrases:
            self._automaton.add_word(phrase, 1)
        self._automaton.make_automaton()
        lengths = [len(p) - self._size + 1 for p in self._passages]
        hashes = np.concatenate([self._hashes(p) for p in self._passages])
        sources = np.repeat(np.asarray(self._sources, np.int64), lengths)
        begins = np.cumsum([0] + [len(p) for p in self._passages[:-1]])
        places = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, lengths, strict=True)])
        order = np.lexsort((sources, hashes))
        self._hash, self._source, self._place = hashes[order], sources[order], places[order]
        self._words = np.concatenate(self._passages)
        self._passages, self._phrases = [], set()

    def _hashes(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return window_hashes(mix(numbers.astype(np.uint64)), self._size)

    def covered(self, doc: int, words: list[str]) -> np.ndarray:
        """For every word, whether such a window of a passage from before ``doc`` covers it."""
        size = self._size
        out = np.zeros(len(words), dtype=bool)
        if self._automaton is None or len(words) < size:
            return out
        numbers = [self._numbers.get(w, 0) for w in words]
        ends = np.fromiter((end for end, _ in self._automaton.iter(tuple(numbers))), np.int64)
        if not len(ends):
            return out
        # the windows that hold an occurrence as a whole
        starts = len(words) - size + 1
        near = np.zeros(starts + 1, np.int64)
        np.add.at(near, np.clip(ends - size + 1, 0, starts), 1)
        np.add.at(near, np.clip(ends - self._phrase + 2, 0, starts), -1)
        asked = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        text = np.asarray(numbers, dtype=np.int64)
        hashes = self._hashes(text)[asked]
        at = np.searchsorted(self._hash, hashes)
        within = np.arange(size)
        edges = np.zeros(len(words) + 1, np.int64)
        while len(asked):
            # the smallest source of a window comes first; a later one counts only if hashes collide
            known = at < len(self._hash)
            known[known] = (self._hash[at[known]] == hashes[known]) & (self._source[at[known]] < doc)
            asked, hashes, at = asked[known], hashes[known], at[known]
            equal = np.ones(len(asked), bool)
            for part in range(0, len(asked), 4096):
                rows = slice(part, part + 4096)
                equal[rows] = (text[asked[rows, None] + within] == self._words[self._place[at[rows], None] + within]).all(axis=1)
            np.add.at(edges, asked[equal], 1)
            np.add.at(edges, asked[equal] + size, -1)
            asked, hashes, at = asked[~equal], hashes[~equal], at[~equal] + 1
        return np.cumsum(edges[:-1]) > 0


def _located(shards: DataFrame, size: int, with_text: bool) -> DataFrame:
    """Rows (shard, kind, doc_id, key, text), sorted by shard with passages (kind 0) before documents."""
    names = ["key", "n_removed", "kept_sha256", "spans"] + (["kept"] if with_text else [])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        shard, automaton, ready = None, None, False
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for now, kind, doc, key, text in zip(*(part.column(c).to_pylist() for c in ("shard", "kind", "doc_id", "key")), texts(part, "text"), strict=True):
                if now != shard:
                    shard, automaton, ready = now, PhraseAutomaton(size), False
                words = WORD.findall(text)
                if kind == 0:
                    automaton.add(doc, words)
                    continue
                if not ready:
                    automaton.compile()
                    ready = True
                gone = automaton.covered(doc, words)
                if gone.any():
                    kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    digest = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, int(gone.sum()), digest, [{"start": a, "stop": b} for a, b in _runs(gone)], kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), spans, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns[: len(names)], kinds[: len(names)], strict=True)], names)

    schema = "key long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>" + (", kept string" if with_text else "")
    return map_arrow(shards, run, schema)


def repeats(docs: DataFrame, size: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept, text_sha256]): one row per document.

    Columns read: doc_id (integer), text. ``spans`` are the removed ranges of words,
    ``kept`` the words left, joined by one space, of documents that lose some (else null).
    Null, empty and short texts lose nothing. Repeated rows and rows of one doc_id are one
    document: they do not remove words from each other. If their texts differ, every one of
    them is compared with other documents. A null doc_id is smaller than none: its rows lose
    nothing and remove nothing.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_sha256", F.sha2("text", 256))
    rows = materialise(_surveyed(source, size))
    # the texts that are searched: each once, under its first document; keys follow the order of documents
    least = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= size)).groupBy("digest").agg(F.min(F.struct("doc_id", "text_sha256")).alias("_least"))
    least = least.select(F.col("digest").alias("_digest"), F.col("_least.doc_id").alias("first"), F.col("_least.text_sha256").alias("_sha"))
    firsts = materialise(with_rank(materialise(least), ["first", "_digest"], "key"))
    mine = (F.col("doc_id") == F.col("first")) & (F.col("text_sha256") == F.col("_sha"))
    anchors = materialise(rows.join(firsts, mine).select("key", F.explode("anchors").alias("anchor")))
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).where("_a < _b")
    shared = materialise(shared.select(F.col("anchor").alias("_anchor")))
    occurring = materialise(anchors.join(shared, F.col("anchor") == F.col("_anchor")).select("key", "anchor"))
    wanted = materialise(occurring.groupBy("key").agg(F.collect_set("anchor").alias("anchors")).join(firsts, "key").select("key", "first", "_sha", "anchors"))
    # the texts in question
    candidates = materialise(source.join(wanted, mine).select("doc_id", "key", "text", "anchors"))

    windows = _recurring_windows(candidates, size).groupBy("window").agg(F.min("key").alias("first"), F.max("key").alias("_last"))
    first_windows = windows.where("first < _last").groupBy("first").agg(F.collect_list("window").alias("windows"))
    found = materialise(passages(candidates, first_windows.withColumnRenamed("first", "key"), size))

    size_of = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of // SHARD_BYTES + 1)
    shard_of = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    reach = occurring.select("anchor", shard_of.alias("shard")).distinct()
    asked = found.select("key", "start", F.explode("anchors").alias("_anchor"))
    sent = reach.join(asked, F.col("anchor") == F.col("_anchor")).select("shard", F.col("key").alias("_key"), F.col("start").alias("_start")).distinct()
    texts_sent = sent.join(found, (F.col("key") == F.col("_key")) & (F.col("start") == F.col("_start")))
    stream = texts_sent.select("shard", F.lit(0).alias("kind"), F.col("source").alias("doc_id"), "key", "text").unionByName(
        candidates.select(shard_of.alias("shard"), F.lit(1).alias("kind"), "doc_id", "key", "text")
    )
    located = materialise(_located(stream.repartition("shard").sortWithinPartitions("shard", "kind"), size, with_text).dropDuplicates(["key"]))

    copies = rows.drop("anchors").join(firsts, F.col("digest") == F.col("_digest"), "left").drop("_digest", "_sha")
    hit = located.withColumnsRenamed({c: f"_{c}" for c in located.columns})
    out = copies.join(hit, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    columns = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("_n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("_spans", F.array().cast("array<struct<start:long,stop:long>>"))).alias("spans"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("_kept")).alias("kept"))
        columns.append("text_sha256")
    return out.select(*columns)


def deduplicate(docs: DataFrame, size: int = 50) -> DataFrame:
    """The documents without repeated passages, in their own columns.

    A text that loses words becomes its other words joined by one space, every other text
    stays as it is. A document of which no word is left is left out. ``n_chars`` follows.
    Equal rows give equal rows; different texts of one doc_id are cut each for itself.
    """
    changed = repeats(docs, size, with_text=True).where("n_removed > 0")
    changed = materialise(changed.select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha"), F.col("kept").alias("_kept")).dropDuplicates(["_doc", "_sha"]))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.join(changed, (F.col("doc_id").cast("long") == F.col("_doc")) & (sha == F.col("_sha")), "left").where("_doc is null or _kept <> ''")
    return restored(docs, rows.withColumn("text", F.coalesce("_kept", "text")).select(*docs.columns))
