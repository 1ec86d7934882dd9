"""SentencePiece ids, spelling variants and periodic runs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import sha, words
from hypothesis import given, settings
from hypothesis import strategies as st

from ocelens.llm import periodic_runs, queries, sentencepieces, spelling
from ocelens.llm.encoders import vocabulary

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*"ab éÜ \n\t!'s12漢😀▁ \x1c\x85\xa0ſİΣ\x00", "<s>", "<unk>", "<0x41>", "  ", "    ", "▁▁", "́", "", "﻿", "the", "ing"]
ROWS = [(0, "Ünïcode and 漢字, 123!  \n\n x"), (1, None), (2, ""), (3, "the same"), (3, "the same"), (None, "no id"), (4, "long " * 50_000), (5, "<s> in a ▁ text"), (6, " \n")]


def frame(spark, rows):
    """With further columns that carry the names of results and of inner columns."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, ids string, n int, word int, runs int")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepieces.PieceEncoder(vocabulary(MODEL))


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_pieces_are_the_librarys(own, library, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)
    own.check()


def test_agenda_without_any_cut(own, library):
    rng = random.Random(3)
    for n in (50, 500, 5000):
        text = "".join(rng.choice("abcdeghilnorst") for _ in range(n))
        assert own.merged("▁" + text) == library.encode(text)
    text = " ".join(rng.choice(["ab", "ing", "the", "12"]) for _ in range(200))
    assert own.merged("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_decoding_of_any_ids(own, library):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_check_tells_differences(own):
    own._fresh = [("▁the", b"\1\0\0\0")]
    with pytest.raises(ValueError, match="the library encodes"):
        own.check()


def test_refused_vocabularies():
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    with pytest.raises(ValueError, match="merge type"):
        sentencepieces.PieceModel(field(1, field(1, b"a")))


def test_piece_tables(spark, library):
    docs = frame(spark, ROWS)
    encoded = sentencepieces.encode(docs, MODEL)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr)
    assert got == sorted(((d, library.encode(t or "")) for d, t in ROWS), key=repr)
    back = sorted(((r.doc_id, r.decoded) for r in sentencepieces.decode(encoded, MODEL).collect()), key=repr)
    assert back == sorted(((d, library.decode(library.encode(t or ""))) for d, t in ROWS), key=repr)
    assert sentencepieces.encode(docs.limit(0), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sentencepieces.decode(nulls, MODEL).first().decoded is None


def test_piece_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, t in docs:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, queries.QUERIES["op12_piece_agenda"](spark, SF).collect())) == sorted(want)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_words(spark, seed):
    rng = random.Random(seed)
    given_words = {"".join(rng.choice("abÿ" if k % 3 else "anb") for _ in range(rng.randint(4, 9))) for k in range(300)}
    given_words |= {"banana", "bananan", "anana", "nanana", "aaaa", "aaaaa", "aaaaaa", "abab", "ababa", "zzzz", "zzzzz", "日本語文", "日本語文字"}
    rows = [(w, 1, "x") for w in given_words] + [("banana", 1, "x"), (None, 1, "x")]
    df = spark.createDataFrame(rows, "word string, near int, side string")
    got = sorted(map(tuple, spelling.near_words(df).collect()))
    assert got == sorted((a, b) for a in given_words for b in given_words if one_edit(a, b))
    assert spelling.near_words(df.limit(0)).count() == 0


def test_short_words_are_refused(spark):
    with pytest.raises(Exception, match="fewer than 4 characters"):
        spelling.near_words(spark.createDataFrame([("abc",), ("abcd",)], "word string")).collect()


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(5)
    for _ in range(300):
        prefix = [(at, rng.randrange(20)) for at in rng.sample(range(9), rng.randint(3, 6))]
        pairs = [(x[1] + y[1]) for i, x in enumerate(prefix) for y in prefix[i + 1 :] if abs(x[0] - y[0]) > 1]
        chosen = spelling.choose_pivots(prefix)
        assert len(chosen) == 2 and chosen[1] - chosen[0] > 1
        assert sum(dict(prefix)[at] for at in chosen) == min(pairs)
    with pytest.raises(ValueError):
        spelling.choose_pivots([(0, 1), (1, 1)])


def plain_forms(counts: dict[str, int], times: int) -> list[tuple]:
    out, form = [], {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None
        out.append([w, n, len(near), form[w], counts[best] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out), key=repr)


def test_forms_and_roots(spark):
    counts = {"letters": 5000, "lettors": 400, "lettorz": 30, "lettorzy": 3, "lettarzy": 3, "letter": 5000, "words": 7, "wordz": 7, "lonely": 2}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n int, form string")
    got = sorted(map(tuple, spelling.forms(df, 10).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)
    assert got == plain_forms(counts, 10)
    assert {r[0]: r[5] for r in got}["lettorzy"] == "letters"
    assert spelling.forms(df.limit(0)).count() == 0


def counted(rows, shortest, least, planted):
    total: dict = {}
    for d, t in rows:
        found = []
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                found.append(run)
                run = ""
        for w in found:
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if planted and h % planted == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] = total.get(w, 0) + 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= least}


@pytest.mark.parametrize("planted", [0, 3])
def test_vocabulary(spark, planted):
    rng = random.Random(6)
    rows = [(d, " ".join(rng.choice(["Straße", "ÉCOLE", "école", "water", "x", "wörter,wörter", "İnce", "a×b÷c", "naïve"]) for _ in range(rng.randrange(60)))) for d in range(40)]
    rows += [(None, "water WATER"), (7, None), (8, ""), (9, "verylongrun" * 20_000)] + rows[:3]
    got = dict(map(tuple, spelling.vocabulary(frame(spark, rows), "[a-zÀ-ÿ]+", 4, 2, planted).collect()))
    assert got == counted(rows, 4, 2, planted)
    assert spelling.vocabulary(frame(spark, rows).limit(0), "[a-z]+").count() == 0


def test_spelling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_pivotal_grams"](spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)
    counts = counted(docs, 7, 2, 31)
    by_cut: dict = {}
    for w in counts:  # words within one edit share a word with one character cut
        for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut.setdefault(key, set()).add(w)
    near: dict = {w: set() for w in counts}
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    assert [(r[0], r[1], r[2]) for r in got] == sorted(((w, counts[w], len(near[w])) for w in counts), key=repr)
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f and counts[f] >= 10 * counts[w] else None for w, f in form.items()}
    assert {r[0]: (r[3], r[4]) for r in got} == {w: (f, counts[f] if f else None) for w, f in form.items()}


def plain_runs(w: list, length: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(length, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


repeated = st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 9)), max_size=5).map(lambda parts: list("".join(s * n for s, n in parts)))


@settings(max_examples=300, deadline=None)
@given(documents=st.lists(repeated, max_size=4), rule=st.sampled_from([(6, 4), (2, 2), (9, 3), (1, 5)]))
def test_maximal_pairs_are_the_runs(documents, rule):
    got = periodic_runs.runs_of(documents, periodic_runs.RunRules(*rule))
    assert got == [plain_runs(w, *rule) for w in documents]


def test_run_tables(spark):
    rows = [*ROWS, (7, "x a b a b a b a b y"), (8, "a b " * 30_000 + "c " * 9), (9, "one two three " * 4), (9, "one two three " * 4)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.runs(frame(spark, rows)).collect()), key=repr)
    want = []
    for d, t in rows:
        w = words(t)
        found = plain_runs(w) if len(w) < 1000 else [(0, 50_000, 1)] if d == 4 else [(0, 60_000, 2), (60_000, 9, 1)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((d, len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.runs(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.RunRules(6, 1)


def test_run_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for d, t in docs:
        w = words(t)
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want.append((d, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(tuple, queries.QUERIES["op13_maximal_pairs"](spark, SF).collect()), key=repr) == sorted(want, key=repr)
