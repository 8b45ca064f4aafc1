import random
import re

import numpy as np

from verivane.llm import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_word_hashes_depend_on_words_alone():
    rng = random.Random(1)
    seen = {}
    for _ in range(300):
        text = bytes(rng.choice(b"ab \n\t\x0b,.\xc3\xa9") for _ in range(rng.randrange(40)))
        words = WORD.findall(text)
        hashes = common.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_change_nothing(monkeypatch):
    text = b" ".join(b"word%d" % (i % 97) for i in range(5000)) + b" " + b"x" * 3000 + b" end"
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "_SLICE", 1000)
    assert (common.word_hashes(text) == whole).all()


def test_words_longer_than_the_table():
    a, b = b"a" * 200000, b"a" * 199999 + b"b"
    assert common.word_hashes(a) != common.word_hashes(b)
    assert common.word_hashes(a + b" c")[0] == common.word_hashes(a)[0]


def test_shingles():
    w = common.word_hashes(b"a b a b a")
    assert len(common.shingles(w, 2)) == 2 and len(common.shingles(w[:1], 2)) == 1 and len(common.shingles(w[:0], 2)) == 0
    assert len(np.unique(common.run_hashes(w, 2))) == 2


def test_small_side_and_tables(spark):
    df = common.materialize(spark.range(10), "t")
    assert common.small_side(df).count() == 10
    common.discard(df)
