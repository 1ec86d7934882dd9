"""Quality rules, chat formatting, sharding and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from brute import covered, near_classes, repeated_words, words
from tokenizers import Tokenizer

import corpus_pipeline
from ocelens.llm import packing, preferences, quality, sharding

PROSE = "Alpha{0} beta{0} gamma{0} delta{0} epsilon{0} zeta{0} eta{0} theta{0}.\n"


def prose(n, start=0):
    return "".join(PROSE.format(start + k) for k in range(n))


def test_measures_match_a_plain_count(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, prose(9)), (3, prose(9)), (None, "a|b"), (4, "x " * 20_000)]
    rows += [(10 + k, "".join(rng.choice(["aa ", "b ", "c\n", "d|# ", "\n", "é "]) for _ in range(rng.randrange(300)))) for k in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, n_words int")
    got = quality.assess(df).collect()
    want = []
    for d, t in rows:
        w, lines = words(t), [line for line in (t or "").split("\n") if words(line)]
        failed = len(w) < 50 or 100 * repeated_words(w) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated_words(w), failed))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.assess(df.limit(0)).count() == 0


def test_line_rules():
    rules = quality.LineRules()
    bad = ["Home | About | News | Contact", "Menu", "Released under the MIT License.", "All rights reserved.", "BUY!! NOW!! THE!! BEST!!", "wo&&& rd%%% and$$$ more***"]
    good = ["Anble anes.", "A long line of words that simply has no full stop", PROSE.format(1).strip(), "She said: \"No!\"", "We are licensed to drive, and " + "so on " * 40]
    assert [quality.line_fails(line, rules) for line in bad + good] == [True] * len(bad) + [False] * len(good)


def test_cleaning(spark):
    menu = "Home | About | News | Contact\n"
    rows = [(1, menu + prose(9) + "All rights reserved."), (2, prose(4) + menu * 30 + "Home | A | B | C | " * 20), (3, prose(9)), (4, None)]
    df = spark.createDataFrame([(d, t, len(t or ""), "s") for d, t in rows], "doc_id long, text string, n_chars long, cleaned string")
    got = {r.doc_id: r for r in quality.clean(df).collect()}
    assert sorted(got) == [1, 3] and quality.clean(df).columns == df.columns
    assert got[1].text == prose(9)[:-1]
    assert got[1].n_chars == len(got[1].text) and got[3].text == prose(9)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "pair_id long, turn long, role string, text string, part string, position int")


def test_common_prefix_is_rendered_once(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", None), (3, 5, "user", "only"), (4, 0, "user", "x"), (4, 0, "user", "x"), (None, 0, "user", "lost")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "other"), (2, 0, None, None), (4, 7, "user", "x"), (4, 9, "assistant", "y")]
    got = preferences.preference_turns(conversations(spark, chosen), conversations(spark, rejected))
    rows = sorted((r.pair_id, r.part, r.position, r.role, r.text, r.trained, r.prompt_turns) for r in got.collect())
    assert rows == [
        (1, "chosen", 2, "user", "r", False, 2),
        (1, "chosen", 3, "assistant", "good", True, 2),
        (1, "prompt", 0, "user", "q", False, 2),
        (1, "prompt", 1, "assistant", "a", False, 2),
        (1, "rejected", 2, "user", "other", False, 2),
        (2, "chosen", 0, "user", "", False, 0),
        (2, "rejected", 0, "", "", False, 0),
        (3, "chosen", 0, "user", "only", False, 0),
        (4, "prompt", 0, "user", "x", False, 1),
        (4, "rejected", 1, "assistant", "y", True, 1),
    ]
    whole = {r.pair_id: r for r in preferences.assembled(got).collect()}
    assert whole[1].prompt == "<|user|>\nq\n<|assistant|>\na\n" and whole[1].rejected == "<|user|>\nother\n"
    assert [(m.chars, m.trained) for m in whole[1].chosen_mask] == [(11, False), (19, True)]
    assert preferences.preference_turns(conversations(spark, []), conversations(spark, [])).count() == 0


def test_replaced_replies(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (2, 2, "assistant", "b2"), (3, 0, "user", "no reply"), (5, 1, "assistant", "a5")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = preferences.replaced_replies(df)
    assert sorted(r.text for r in chosen.collect()) == ["a1", "a2", "a5", "b2", "no reply", "q1", "q2"]
    assert sorted((r.pair_id, r.text) for r in rejected.collect()) == [(1, "b2"), (1, "q1"), (2, "a2"), (2, "a5"), (2, "q2"), (3, "no reply"), (5, "a1")]
    turns = preferences.preference_turns(chosen, rejected).where("pair_id = 3").collect()
    assert [(r.part, r.text, r.trained) for r in turns] == [("prompt", "no reply", False)]


def test_shards_hold_the_mixture(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["", "é", "abc"]) * rng.randrange(5), "hot" if k % 3 else f"s{k % 7}") for k in range(700)]
    rows += [(701, None, None), (702, None, None), (5, "twice", "hot"), (5, "twice", "hot")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, shard int, _rank string")
    got = sharding.interleave(df, 8).collect()
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == Counter((d, s, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, s in rows)
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for source, n in Counter(s for *_, s in rows).items():  # as even as whole rows allow
        each = Counter(r.shard for r in got if r.source == source)
        assert all(abs(each[k] - n / 8) <= 2 for k in range(8))
    again = sharding.interleave(df.repartition(3), 8)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert sharding.interleave(df.limit(0), 8).count() == 0


def test_pipeline_against_plain_steps(spark, tmp_path):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, prose(12, 40 * k)) for k in range(6)]
    rows += [(20, rows[2][1]), (21, rows[3][1].replace("beta125", "simple")), (22, None), (23, "Home | About | News | Contact\n" * 30)]
    rows += [(30 + k, prose(9, 1000 + 40 * k) + passage + ".\n" + prose(3, 5000 + 40 * k)) for k in range(4)]
    rows += [(40, "All rights reserved.\n" + prose(10, 9000))]
    rows += [(50, prose(9, 20_000)), (50, prose(9, 30_000)), (51, prose(9, 20_000)), (51, prose(9, 40_000))]  # ids with several texts
    rng.shuffle(rows)
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    rules, kept = quality.LineRules(), []
    for d, t in rows:
        w = words(t)
        lines = [line for line in (t or "").split("\n") if not (words(line) and quality.line_fails(line, rules))]
        lost = 1 - len("".join(words("\n".join(lines)))) / max(1, len("".join(w)))
        if len(w) >= 50 and 2 * repeated_words(w) <= len(w) and lost <= rules.max_lost:
            kept.append((d, "\n".join(lines)))
    kept = [(d, t) for (d, t), c in zip(kept, near_classes(kept), strict=True) if c == d]
    out = []
    for (d, t), gone in zip(kept, covered(kept, 50), strict=True):
        out.append((d, " ".join(w for w, g in zip(words(t), gone, strict=True) if not g) if any(gone) else t))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in out:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got.collect()) == sorted(want)
    assert {20, 22, 23} & {d for d, *_ in want} == set() and {30, 31, 40} <= {d for d, *_ in want}
    assert [d for d, *_ in want if d in (50, 51)] == [50, 50, 51]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name
    assert packing.pack(packing.cut(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 2048, 1, False), 2048).count() == 0
