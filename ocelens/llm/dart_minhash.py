"""Near-duplicates by DartMinHash signatures and banded joining (operator 2).

A document is the weighted set of its five-word shingles. For every shingle darts are
thrown at the plane of weight and time: the plane is cut into weight regions [0,1), [1,2),
[2,4), ... and the darts of a region arrive as a Poisson process that a hash of the shingle
alone decides. The darts below a shingle's weight and before a common horizon hit the
document; each dart belongs to one of the signature's coordinates, and every coordinate
keeps its earliest dart. Two documents keep the same dart with the probability of their
weighted Jaccard similarity. The number of darts hardly depends on the length of a text.

Documents are joined on bands of coordinates. A band that many share is not expanded into
pairs: every member is compared with the smallest one first. Only where members of a band
still belong to different classes, they are compared in blocks, task by task, and a task
gives back no more links than it has classes. Every link is verified on the whole texts.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_rank
from ocelens.llm.arrow import map_arrow, ship, slices, texts
from ocelens.llm.components import components
from ocelens.llm.words import GOLDEN, WORD, mix, window_hashes, word_hashes
from ocelens.session import materialise

@dataclass(frozen=True)
class Sketch:
    """Five words and 24 bands of 5: a pair at 0.8 shares no band once in 14,000 times."""

    words: int = 5
    bands: int = 24
    rows: int = 5
    similarity: float = 0.8

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates that a pair at the similarity falls short of once in a million."""
        n, p, tail = self.coordinates, self.similarity, 0.0
        for k in range(n + 1):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > 1e-6:
                return k
        return n


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the windows of ``size`` words; fewer words are one window."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))), return_counts=True)


def throw(elements: np.ndarray, weights: np.ndarray, sizes: list[int], coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate, one row for each of several documents.

    The documents' elements stand one after another, ``sizes`` of them each, one at least;
    weights are positive.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    top = float(weights.max())
    regions = [(0.0, 1.0)] + [(2.0**k, 2.0 ** (k + 1)) for k in range(math.ceil(math.log2(top)) if top > 1 else 0)]
    horizon = coordinates * (math.log(coordinates) + 4) / np.bincount(owner, weights)
    found = np.zeros(len(sizes) * coordinates, np.uint64)
    open_, member = np.arange(len(sizes)), np.ones(len(elements), bool)
    with np.errstate(over="ignore"):
        while len(open_):
            earliest = np.full(len(found), np.inf)
            hits = []
            for number, (low, high) in enumerate(regions):
                reached = member & (weights > low)
                stream = mix(elements[reached] + GOLDEN * np.uint64(number + 1))
                weight, doc = weights[reached], owner[reached]
                time, arrival = np.zeros(len(stream)), 0
                while len(stream):
                    arrival += 1
                    dart = mix(stream + GOLDEN * np.uint64(2 * arrival))
                    time = time - np.log(_unit(dart)) / (high - low)
                    alive = time < horizon[doc]
                    stream, weight, doc, time, dart = stream[alive], weight[alive], doc[alive], time[alive], dart[alive]
                    dart = mix(dart ^ GOLDEN)
                    # the height of the dart in its region decides whether it is below the weight
                    below = low + (high - low) * (_unit(mix(dart + GOLDEN)) - 2.0**-53) < weight
                    place = doc[below] * coordinates + (dart[below] % np.uint64(coordinates)).astype(np.int64)
                    np.minimum.at(earliest, place, time[below])
                    hits.append((place, time[below], dart[below]))
            for place, time, dart in hits:
                first = time == earliest[place]
                found[place[first]] = dart[first]
            # a coordinate without a dart: throw again as far as twice the horizon
            open_ = open_[np.isinf(earliest.reshape(-1, coordinates)[open_]).any(axis=1)]
            horizon[open_] *= 2
            member = np.isin(owner, open_)
    return found.reshape(-1, coordinates)


def _band_keys(signatures: np.ndarray, sketch: Sketch) -> np.ndarray:
    rows = signatures.reshape(-1, sketch.bands, sketch.rows)
    keys = np.broadcast_to(np.arange(1, sketch.bands + 1, dtype=np.uint64), rows.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(sketch.rows):
            keys = mix(keys * GOLDEN + rows[:, :, k])
    return keys


def sign(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, text_hash, rest_hash, words_digest, n_shingles, bands, marks); no words: null bands and marks.

    ``words_digest`` names the sequence of words, ``marks`` has one byte per coordinate. The
    two hashes tell rows of one doc_id apart, by their text and by their other columns.
    """

    def run(batches):
        for part in slices(batches, "text", 128 << 10):
            digests, sets = [], []
            for text in texts(part, "text"):
                words = WORD.findall(text)
                digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                sets.append(shingles(words, sketch.words))
            bands: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            solid = [i for i, (elements, _) in enumerate(sets) if len(elements)]
            if solid:
                thrown = throw(
                    np.concatenate([sets[i][0] for i in solid]),
                    np.concatenate([sets[i][1] for i in solid]).astype(np.float64),
                    [len(sets[i][0]) for i in solid],
                    sketch.coordinates,
                )
                keys, bytes_ = _band_keys(thrown, sketch).view(np.int64), (thrown >> np.uint64(40)).astype(np.uint8)
                for row, i in enumerate(solid):
                    bands[i], marks[i] = keys[row], bytes_[row].tobytes()
            sizes = [int(counts.sum()) for _, counts in sets]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "text_hash", "rest_hash")), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "text_hash", "rest_hash", "words_digest", "n_shingles", "bands", "marks"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_names(docs), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, text_hash long, rest_hash long, words_digest binary, n_shingles long, bands array<long>, marks binary")


def _row_names(docs: DataFrame) -> list[Column]:
    """text_hash and rest_hash, which with the doc_id tell all different rows apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    other = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    return [F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), other.alias("rest_hash")]


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][bt]).sum())
    return both >= least * (int(a[1].sum()) + int(b[1].sum()) - both) - 1e-9


def verified(pairs: DataFrame, bodies: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) whose whole texts have the similarity; bodies are (doc_id, text)."""

    def run(batches):
        for batch in batches:
            last, known = None, None
            for part in slices([batch], "_text_a"):
                left, right = part.column("a").to_pylist(), part.column("b").to_pylist()
                keep = []
                for a, text_a, text_b in zip(left, texts(part, "_text_a"), texts(part, "_text_b"), strict=True):
                    if a != last:
                        last, known = a, shingles(WORD.findall(text_a), sketch.words)
                    keep.append(_similar(known, shingles(WORD.findall(text_b), sketch.words), sketch.similarity))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, k in zip(ids, keep, strict=True) if k], pa.int64()) for ids in (left, right)], ["a", "b"]
                )

    joined = pairs.join(bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("_text_b")), "b").join(
        bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("_text_a")), "a"
    )
    return map_arrow(joined.select("a", "b", "_text_a", "_text_b"), run, "a long, b long")


def _alike(pairs: DataFrame, signed: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs that sizes and signatures do not rule out."""
    a, b = ([F.col("doc_id").alias(s), F.col("marks").alias(f"_m{s}"), F.col("n_shingles").alias(f"_n{s}")] for s in "ab")
    joined = pairs.join(signed.select(*a), "a").join(signed.select(*b), "b")
    joined = joined.where(F.least("_na", "_nb") >= F.greatest("_na", "_nb") * sketch.similarity)
    least = sketch.least_equal

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, sketch.coordinates) for c in ("_ma", "_mb"))
            keep = pa.array((left == right).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return map_arrow(joined.select("a", "b", "_ma", "_mb"), run, "a long, b long").distinct()


def _links_in_blocks(members: DataFrame, sketch: Sketch, rows: int = 128, shingles_: int = 1 << 18) -> DataFrame:
    """(a, b): links between classes of a family, enough to join all that are linked.

    Columns: family, doc_id, label, n_shingles, marks, bands, text. Members of a family are
    dealt to blocks of at most so many rows and, about, shingles; a task compares two
    blocks. A pair counts if it shares a band, and is verified unless the links found in
    the task have joined its labels already, so a task gives back less links than labels.
    """
    sizes = members.groupBy("family").agg(
        F.ceil(F.greatest(F.count("*") / rows, F.sum("n_shingles") / shingles_)).cast("int").alias("blocks")
    )
    sizes = materialise(sizes.withColumnRenamed("family", "_family"))
    joined = members.join(sizes, F.col("family") == F.col("_family")).withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = joined.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", "doc_id", "label", "n_shingles", "marks", "bands", "text", "_own",
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
    )
    least, similarity = sketch.least_equal, sketch.similarity

    def compare(table: pa.Table) -> pa.Table:
        ids, labels, sizes_, own = (table.column(c).to_numpy() for c in ("doc_id", "label", "n_shingles", "_own"))
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, sketch.coordinates)
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, sketch.bands)
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        text, known = table.column("text"), {}
        root = {label: label for label in labels.tolist()}

        def top(label: int) -> int:
            while root[label] != label:
                root[label] = label = root[root[label]]
            return label

        def body(row: int) -> tuple[np.ndarray, np.ndarray]:
            if row not in known:
                known[row] = shingles(WORD.findall(text[row].as_py()), sketch.words)
            return known[row]

        right, out = np.flatnonzero(own == j), []
        for at in np.flatnonzero(own == i).tolist():
            other = right[(labels[right] != labels[at]) & ((ids[right] > ids[at]) | (i != j))]
            other = other[np.minimum(sizes_[other], sizes_[at]) >= similarity * np.maximum(sizes_[other], sizes_[at])]
            other = other[(bands[other] == bands[at]).any(axis=1)]
            equal = (marks[other] == marks[at]).sum(axis=1)
            for row in other[np.argsort(-equal, kind="stable")][: int((equal >= least).sum())].tolist():
                a, b = top(int(labels[at])), top(int(labels[row]))
                if a != b and _similar(body(at), body(row), similarity):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[at]), int(ids[row])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    ship(members.sparkSession)
    return dealt.groupBy("family", "_i", "_j").applyInArrow(compare, "a long, b long")


def _classed(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, text_hash, rest_hash, component_id, kept) of every row."""
    signed = materialise(sign(docs, sketch).withColumn("row", F.monotonically_increasing_id()))
    # copies first: a group of equal texts goes on as the row of its smallest document; the
    # numbers of the groups follow the order of these, as one doc_id may have several texts
    least = signed.where("marks is not null and doc_id is not null").groupBy("words_digest").agg(
        F.min(F.struct("doc_id", "text_hash", "rest_hash", "row")).alias("_least")
    )
    least = least.select(F.col("words_digest").alias("_digest"), F.col("_least.doc_id").alias("first"), F.col("_least.text_hash").alias("_text"), F.col("_least.rest_hash").alias("_rest"), F.col("_least.row").alias("_number"))
    firsts = materialise(with_rank(materialise(least), ["first", "_digest"], "key"))
    chosen = signed.join(firsts, (F.col("words_digest") == F.col("_digest")) & (F.col("row") == F.col("_number")))
    chosen = materialise(chosen.select(F.col("key").alias("doc_id"), "n_shingles", "marks", "bands"))
    # from here on a document is the number of its group
    narrow = chosen.select("doc_id", "n_shingles", "marks")
    listed = chosen.select("doc_id", F.explode("bands").alias("bucket"))
    lows = listed.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("_high"))
    lows = materialise(lows.where("low < _high").select(F.col("bucket").alias("_bucket"), "low"))
    shared = materialise(listed.join(lows, F.col("bucket") == F.col("_bucket")).select("bucket", "doc_id", "low"))

    # the texts that may be compared, moved once
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), _row_names(docs)[0], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = shared.select("doc_id").distinct().join(firsts.select(F.col("key").alias("doc_id"), "first", "_text"), "doc_id")
    bodies = source.join(asked, (F.col("_id") == F.col("first")) & (F.col("text_hash") == F.col("_text")))
    bodies = materialise(bodies.select("doc_id", "text").dropDuplicates(["doc_id"]))

    # every member of a band with its smallest member
    stars = shared.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = materialise(verified(_alike(stars, narrow, sketch), bodies, sketch))
    found = materialise(components(edges).select(F.col("id").alias("_id"), F.col("component").alias("_component")))

    # bands that still have several classes; their members, joined over bands, are a family
    rows = materialise(shared.join(found, F.col("doc_id") == F.col("_id"), "left").select(*shared.columns, F.coalesce("_component", "doc_id").alias("label")))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b")
    rest = materialise(rows.join(materialise(mixed.select(F.col("bucket").alias("_bucket"))), F.col("bucket") == F.col("_bucket")).drop("_bucket"))
    families = components(rest.select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    members = rest.select("doc_id", "label").distinct().join(families, "doc_id").join(chosen, "doc_id").join(bodies, "doc_id")
    more = materialise(_links_in_blocks(materialise(members), sketch))
    found = materialise(components(edges.unionByName(more)).select(F.col("id").alias("_id"), F.col("component").alias("_component")))

    grouped = firsts.join(found, F.col("key") == F.col("_id"), "left").select("_digest", "first", "_text", "_rest", "key", F.coalesce("_component", "key").alias("_root"))
    roots = firsts.select(F.col("key").alias("_root"), F.col("first").alias("_class"))
    grouped = materialise(grouped.join(roots, "_root"))
    named = signed.select("doc_id", "text_hash", "rest_hash", F.when(F.col("marks").isNotNull(), F.col("words_digest")).alias("words_digest"))
    named = named.join(grouped, F.col("words_digest") == F.col("_digest"), "left")
    alone = F.col("_digest").isNull()
    stays = (F.col("key") == F.col("_root")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("_text")) & (F.col("rest_hash") == F.col("_rest"))
    return named.select("doc_id", "text_hash", "rest_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("_class")).alias("component_id"), F.when(alone, F.lit(True)).otherwise(stays).alias("kept"))


def classes(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """(doc_id, component_id, kept): one row per document, near-duplicates in one class.

    Columns read: doc_id (integer), text; the others only to tell rows of one doc_id apart.
    Documents link if the weighted Jaccard similarity of their shingles is at least
    ``sketch.similarity``; a class is what links reach, its id the smallest doc_id in it,
    and one document of the class is kept, of that id. Words are runs without ASCII white
    space, taken as they are; a text of fewer words than a shingle is one shingle, a text
    of any length is taken whole. A text without a word (null, empty, blank) is in a class
    of its own. Rows of one doc_id with different texts are documents of their own; an
    equal row gives an equal result. A null doc_id is the copy of any document with the
    same words, without one it has the class null and is kept. An empty table gives none.
    """
    return _classed(docs, sketch or Sketch()).select("doc_id", "component_id", "kept")


def deduplicate(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, equal rows once.

    Rows without a doc_id cannot be named as kept or not, so all their texts stay. Of rows
    with equal doc_id and text whose other columns differ, one stays, always the same.
    """
    kept = _classed(docs, sketch or Sketch()).where("kept and doc_id is not null")
    # a text without words has no group: of its rows the one of smallest hash stays
    kept = kept.groupBy("doc_id", "text_hash").agg(F.min("rest_hash").alias("_rest")).select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_text"), "_rest")
    names = [c.alias(f"_row_{n}") for c, n in zip(_row_names(docs), ("text", "rest"), strict=True)]
    same = (F.col("doc_id").cast("long") == F.col("_kept")) & (F.col("_row_text") == F.col("_text")) & (F.col("_row_rest") == F.col("_rest"))
    named = docs.select("*", *names).join(materialise(kept), same).dropDuplicates(["_kept", "_text"]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
