"""Operator 11 against brute force over all pairs, and over edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from extremes.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def distance_one(a, b):
    """One inserted, deleted or replaced code point, by trying all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [x for x in counts if x != w and distance_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def made(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("letters, size, block", [("ab", 700, 256), ("abcé🙂", 900, 256), ("ab", 500, 16), ("abcd", 600, 5)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, letters, size, block):
    """Groups of one block and of many, lengths from 1, ties in n, letters outside of the first plane."""
    rng = random.Random(size + block)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 11))): rng.choice([1, 2, 3, 6, 12, 30, 100]) for _ in range(size)}
    monkeypatch.setattr(spelling, "BLOCK", block)  # the plan's; tasks take tiles of any size
    assert rows(spelling.spelling_variants(made(spark, counts))) == brute(counts)


def test_a_chain_of_forms_ends_at_its_root(spark):
    counts = {"a" * k + "b" * (40 - k): 3 * 2**k for k in range(41)}
    got = {r.word: r for r in spelling.spelling_variants(made(spark, counts)).collect()}
    assert {r.root for r in got.values()} == {"a" * 40} and got["b" * 40].form == "a" + "b" * 39 and got["a" * 40].form is None


def test_edges(spark):
    assert spelling.spelling_variants(made(spark, {"x": 1}).where("false")).count() == 0
    long = "z" * 60_000
    counts = {"": 5, "q": 9, long: 2, long + "y": 7, "y" + long[1:]: 4}
    words = made(spark, counts).unionByName(spark.createDataFrame([(None, 3)], "word string, n long")).selectExpr("*", "1 AS form", "2 AS part", "'x' AS d")
    assert rows(spelling.spelling_variants(words)) == brute(counts)
    with pytest.raises(ValueError):
        spelling.spelling_variants(words, ratio=1)


def test_words_are_counted_over_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    texts = [None, "", "Ärger ärger ÄRGER abcde÷f x", "Words " * 500 + "W" * 300, "no letters: 12 --", "Words"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    want = Counter(x for t in texts * 2 for w in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(x := "".join(c.lower() if c.isascii() else c for c in w)) >= 5)
    assert {r.word: r.n for r in spelling.count_words(docs, least_count=2).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.count_words(docs.where("false")).count() == 0


def test_pieces_join_up_to_the_text():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abÉ 1\n"), 5000))
    old, spelling.PIECE = spelling.PIECE, 7
    try:
        assert sum(map(list, spelling._runs(text)), []) == re.findall("[A-Za-zÀ-ÿ]+", text)
    finally:
        spelling.PIECE = old


def test_query_is_brute_force_over_the_table(spark):
    counts = Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run, n in Counter("".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", d.text or "")).items():
            h = zlib.crc32(f"{d.doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = rows(queries.op11_spelling(spark, SF))
    assert len(got) == len(counts) > 1000 and got == brute(counts)
