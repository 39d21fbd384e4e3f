"""Each operator against brute force, an exact round trip or held-out accuracy, and over edge cases."""

import base64
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from extremes.llm import chat, decontaminate, jaccard, langid, licenses, merkle, packing, quality, queries, token_counts, token_matrix
from extremes.llm.connected import components
from extremes.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"
CLASH = "0 AS n, 'x' AS cls, 1 AS bucket, 2 AS _at, 3 AS _key, 4 AS y, 5 AS lang_id, 6 AS leaks, 7 AS node, 8 AS k, 9 AS salt, 10 AS _tree"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, ties, repeated rows, a very long text, null ids, clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "the same text of words here now", "en", "a", 31), (2, "the same text of words here now", "en", "a", 31), (2, "the same text of words here now", "en", "a", 31), (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t ", None, "b", 4), (6, long, "en", "b", len(long)), (7, "l’été, où ça? 12 🙂", "fr", "c", 19), (None, "no id at all", "en", "c", 12), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH.split(", "))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


# 1 quality


def test_quality_tells_labels_kept_out_of_training(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality.train(docs, labels.where(~out), quality.good())
    got = quality.score(docs, model).join(labels.where(out), "doc_id").select("judged.p_quality", quality.good().alias("good")).toPandas()
    assert len(got) > 60 and ((got.p_quality >= 0.5) == got.good).mean() > 0.8


def test_co_training_teaches_the_weaker_view():
    """Few labels, a large pool: words tell the kinds apart, and teach the metadata, which so few labels fit badly."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 6000)
    slots = [np.unique(np.r_[rng.integers(100, 60_000, 20), [1 + v, 11 + v, 21 + v]]).astype(np.int32) for v in y]
    pages = 0.2 * (2 * y[:, None] - 1) + rng.normal(0, 1, (6000, 100))
    told, kept = np.where(np.arange(6000) < 300, y, -1), slice(5000, 6000)  # the last ones are in no pool
    right = {}
    for rounds in (0, 4):
        model = quality.co_train(slots[:5000], pages[:5000], told[:5000], rounds=rounds)
        text = np.array([np.isin(model.chosen, s).astype(float) @ model.text[:-1] + model.text[-1] for s in slots[kept]])
        page = (pages[kept] - model.centre) / model.spread @ model.page[:-1] + model.page[-1]
        both = text * model.blend[0] + page * model.blend[1] + model.blend[2]
        right[rounds] = [((z > 0) == y[kept]).mean() for z in (text, page, both)]
    assert right[4][1] > right[0][1] + 0.015, right
    assert min(right[4][0], right[4][2]) > 0.95, right
    assert quality.co_train(slots[:3], pages[:3], np.array([1, 1, -1])).text is None


def test_fits_settle(monkeypatch):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    x = [rng.normal(0, 1, (300, k)) + y[:, None] * 0.3 for k in (5, 30)]
    got = quality._fit(x, y.astype(float), [np.zeros(6), np.zeros(31)], None, [])
    for view, w in zip(x, got, strict=True):
        error = 1 / (1 + np.exp(-(view @ w[:-1] + w[-1]))) - y
        assert np.abs(np.r_[error @ view / 300 + 1e-3 * w[:-1], error.mean()]).max() <= quality.SETTLED
    monkeypatch.setattr(quality, "PASSES", 2)
    with pytest.raises(RuntimeError, match="settled"):
        quality._fit(x, y.astype(float), [np.zeros(6), np.zeros(31)], None, [])


def test_quality_pool_is_every_unlabelled_row(spark):
    ids = spark.range(9000).withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(11)), "id")))
    kind = F.col("id") % 2
    text = F.concat(F.when(kind == 1, F.lit("alpha beta gamma delta")).otherwise(F.lit("omega psi chi phi")), F.lit(" w"), F.col("id") % 50)
    # those last in the order of the hash, beyond the first 5000 without label: good texts of a source of their own
    source = F.when((F.col("at") > 8000) & (kind == 1), "late").otherwise("early")
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), F.lit("en").alias("lang"), F.length(text).alias("n_chars"))
    labels = ids.where("at <= 600").select(F.col("id").alias("doc_id"), kind.cast("int").alias("quality"))
    model = quality.train(docs, labels, F.col("quality") == 1)
    pages = {s: quality.page_features("alpha beta gamma delta w1", s, "en", 25) for s in ("late", "never")}
    late, never = (((x - model.centre) / model.spread) @ model.page[:-1] for x in pages.values())
    assert late > never + 0.1


def _judge_brute(model, text, source, lang, n_chars):
    """Both views and their blend, feature by feature."""
    own = set(quality.text_slots(text or "").tolist())
    a = sum(w for slot, w in zip(model.chosen.tolist(), model.text, strict=False) if slot in own) + model.text[-1]
    page = quality.page_features(text or "", source, lang, n_chars)
    b = sum((x - c) / s * w for x, c, s, w in zip(page, model.centre, model.spread, model.page, strict=False)) + model.page[-1]
    return [1 / (1 + math.exp(-z)) for z in (a, b, a * model.blend[0] + b * model.blend[1] + model.blend[2])]


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for d, n in ((odd, 10), (empty, 0)):
        rows = quality.score(d, quality.train(d, labels, quality.good())).collect()
        assert len(rows) == n and all(r.judged.p_quality == 0.0 for r in rows) == (n > 0 or not rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.good())
    for r in quality.score(odd, model).collect() + quality.score(docs, model).limit(30).collect():
        assert list(r.judged) == pytest.approx(_judge_brute(model, r.text, r.source, r.lang, r.n_chars), abs=1e-4)
    assert quality.score(odd, quality.Model(0.5)).select("judged.p_quality").distinct().collect() == [(0.5,)]


# 2 decontamination


def _impacts(items):
    """Shares of every item's words, and its passage length, from the definition."""
    words = [decontaminate.split_words(t) for _, t in items]
    df = {w: sum(w in x for x in words) for own in words for w in own}
    mean = sum(map(len, words)) / max(len(words), 1)
    return [(decontaminate.impacts_of(own, df, len(items), mean), max(64, 2 ** math.ceil(math.log2(2 * len(own))))) for own in words]


def _leaks_brute(items, text, threshold=0.5, overlap=0.5):
    """Every passage of the text scored against every item."""
    words, out = decontaminate.split_words(text), {}
    for (item_id, item), (share, passage) in zip(items, _impacts(items), strict=True):
        step = passage // 2
        for lo in range(0, max(1, len(words) - step), step):
            have = set(words[lo : lo + passage])
            s = sum(x for w, x in share.items() if w in have)
            if s + 1e-9 < threshold:
                continue
            near, shares = words[max(0, lo - step) : lo + passage + step], []
            for part in decontaminate.question_and_answer(item):
                n = min(3, len(part))
                own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if part else set()
                shares.append(sum(any(tuple(near[i : i + n]) == g for i in range(len(near))) for g in own) / len(own) if own else 1.0)
            if min(shares) >= overlap:
                out[item_id] = max(out.get(item_id, 0), s)
    return out


def _long_items(seed, sizes):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(4000)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    return rng, word, [(i, " ".join(word() for _ in range(n - 3)) + ". " + " ".join(word() for _ in range(3))) for i, n in enumerate(sizes)]


def test_block_max_wand_is_exhaustive_search():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for i in range(90)]
    df = {w: sum(w in t.split() for _, t in items) for w in vocabulary}
    index = decontaminate.Index(items, df, len(items), 17, 64)
    for _ in range(200):
        words = set(rng.sample(vocabulary, rng.randint(3, 60)) + rng.choice(items)[1].split()[: rng.randint(0, 30)])
        got = dict(index.above(sorted({index.terms[w] for w in words if w in index.terms}), 0.4))
        want = {i: s for i, (_, t) in enumerate(items) if (s := sum(x for w, x in decontaminate.impacts_of(t.split(), df, len(items), 17).items() if w in words)) + 1e-9 >= 0.4}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize(("shard_items", "portion_bytes"), [(256, 1 << 26), (3, 20_000)])
def test_leaks_are_those_of_every_passage(spark, shard_items, portion_bytes):
    """Items of 5 to 600 words; whole, halved, scattered and without answer, deep in long texts."""
    rng, word, items = _long_items(2, [5, 6, 9, 12, 20, 31, 32, 33, 48, 64, 65, 130, 250, 256, 260, 300, 520, 600])
    texts = ["", None]
    for k, (_, t) in enumerate(items):
        w = t.split()
        cases = [w, w[len(w) // 4 :], w[: len(w) // 2], w[len(w) // 2 :], w[:-3], w[: -len(w) // 4], [x for x in w if rng.random() < 0.7], rng.sample(w, len(w))]
        texts += [" ".join([word() for _ in range(rng.randrange(300))] + c + [word() for _ in range(rng.randrange(300))]) for c in (cases if k % 2 else cases[:4])]
    texts.append(" ".join([word() for _ in range(60_000)] + items[8][1].split()[:26] + items[10][1].split()))
    texts = list(enumerate(texts))
    index = decontaminate.build(spark.createDataFrame(items, "item_id long, text string"), shard_items, portion_bytes)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, x.item_id): x.score for r in decontaminate.find_leaks(df, index).collect() for x in r.leaks}
    want = {(d, i): s for d, t in texts for i, s in _leaks_brute(items, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 30


def test_a_portion_is_read_once_for_many_texts(monkeypatch):
    """However many batches the texts come in; leaks are those of an index in one portion."""
    _, word, items = _long_items(5, [20, 30, 40, 50] * 6)
    df = Counter(w for _, t in items for w in set(decontaminate.split_words(t)))
    shards = [decontaminate.Index(items[k : k + 6], df, len(items), 35, 128) for k in range(0, 24, 6)]

    class Held:
        def __init__(self, portions):
            self.portions, self.reads = portions, 0

        def read(self):
            for portion in self.portions:
                self.reads += 1
                yield decontaminate.Portion(portion)

    texts = [None, ""] + [" ".join([word() for _ in range(40)] + items[k % 24][1].split()) for k in range(60)]
    parts = [pd.Series(texts[i : i + 5], dtype=object) for i in range(0, len(texts), 5)]
    size = max(len(t or "") for t in texts)

    def run(portions, held):
        monkeypatch.setattr(decontaminate, "HELD_CHARS", held)
        monkeypatch.setattr(decontaminate, "TEXT_CHARS", 3 * size)
        index = Held(portions)
        found = [sorted(x) for part in decontaminate.leaks_of(iter(parts), index, 0.5, 0.5) for x in part]
        return found, index.reads

    want, reads = run([shards], 10**9)
    assert reads == 1 and len(want) == len(texts) and sum(map(bool, want)) >= 60
    assert run([[s] for s in shards], 10**9) == (want, 4)
    got, reads = run([[s] for s in shards], 10 * size)
    assert got == want and 4 < reads <= 4 * (sum(len(t or "") for t in texts) // (10 * size) + 1)
    assert list(decontaminate.leaks_of(iter([]), Held([shards]), 0.5, 0.5)) == []


def test_a_missing_answer_is_no_leak(spark):
    rng, word, items = _long_items(3, [250, 260, 300, 520])
    question = lambda t: " ".join(t.split(". ")[0].split())
    df = spark.createDataFrame([(i, question(t)) for i, t in items], "doc_id long, text string")
    index = decontaminate.build(spark.createDataFrame([(i, question(t) + ". alpha beta gamma delta epsilon zeta") for i, t in items], "item_id long, text string"))
    assert decontaminate.find_leaks(df, index).where("size(leaks) > 0").count() == 0


def test_half_an_item_behind_many_frequent_words():
    """Sums over a long text lose nothing: the items are found however much stands before them."""
    items = [(i, " ".join(f"{'abcdefghij'[i]}{k}" for k in range(47)) + " the") for i in range(10)]
    df = {w: sum(w in t.split() for _, t in items) for _, text in items for w in text.split()}
    index = decontaminate.Index(items, df, 10, 48, 128)
    for before in (0, 20_000, 40_000, 60_000):
        words = ["the"] * (before - before % 64) + items[3][1].split()[:24] + ["the"]
        share = decontaminate.impacts_of(items[3][1].split(), df, 10, 48)
        s = sum(share[w] for w in set(words))
        assert [i for i, *_ in index.leaks(words, s, 0.0)] == [3]


def test_leaks_are_the_items_that_texts_hold(spark, docs, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, x.item_id) for r in decontaminate.find_leaks(docs, decontaminate.build(items, 7)).collect() for x in r.leaks}
    plain = lambda t: " ".join(decontaminate.split_words(t))
    want = {(d, r.item_id) for r in items.collect() for d, t in rows if f" {plain(r.text)} " in f" {plain(t)} "}
    assert want and want <= got and len(got) <= len(want) + 1


def test_decontamination_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "the same text of words here now"), (1, "the same text of words here now"), (1, "no such words"), (2, None), (3, ""), (None, "no id at all"), (4, "été")], "item_id long, text string")
    free = odd.withColumnRenamed("leaks", "kept")
    rows = decontaminate.find_leaks(free, decontaminate.build(items)).collect()
    assert sorted((r.doc_id, *(x.item_id for x in r.leaks)) for r in rows if r.leaks and r.doc_id) == [(1, 1), (2, 1), (2, 1), (7, 4)]
    assert [x.item_id for r in rows if r.text == "no id at all" for x in r.leaks] == [None] and {r.kept for r in rows} == {6}
    none = decontaminate.build(items.where("false"))
    assert decontaminate.find_leaks(free, none).where("size(leaks) > 0").count() == 0 and decontaminate.find_leaks(empty.drop("leaks"), none).collect() == []


# 3 packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, k):
    import itertools

    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])
    cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
    best = min(cost([*some, lengths[-1]]) for j in range(k) for some in itertools.combinations(lengths[:-1], min(j, len(lengths) - 1)))
    got = packing.best_boundaries(lengths, counts, k)
    assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best


def test_long_lengths_are_exact(spark):
    rows = [(i, 5001) for i in range(4)] + [(9, 5002), (10, 70_003), (11, 70_004), (12, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(df, F.col("n"), 8).toPandas()
    assert (got.padding == 0).all() and set(got.bucket_len) == {1, 5001, 5002, 70_003, 70_004}
    two = packing.pack(df, F.col("n"), 2).toPandas()
    assert two.padding.sum() == 5001 + 1 + 4 + 1 - 1 and set(two.bucket_len) == {5002, 70_004}


def test_op3_against_brute_force(spark, rows):
    """Cuts from all sets of cuts; batches by the order of the hash."""
    import itertools

    got = queries.op3_packing(spark, SF).toPandas()
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for i, t in rows}
    lengths, counts = np.unique(list(size.values()), return_counts=True)
    ends = packing.best_boundaries(lengths, counts, 3)
    cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
    some = lengths[:-1] if len(lengths) < 60 else lengths[:-1:2]
    assert cost(ends) <= min(cost([*cut, lengths[-1]]) for cut in itertools.combinations(some, 2))
    first, want = 0, {}
    for k, end in enumerate(sorted(set(got.bucket_len))):
        own = sorted((i for i in size if size[i] <= end and i not in want), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        per = max(1, 32768 // end)
        want |= {i: (size[i], k, end, first + n // per, n % per, end - size[i]) for n, i in enumerate(own)}
        first += -(-len(own) // per)
    assert {r.doc_id: tuple(r)[1:] for r in got.itertuples(index=False)} == want


def test_batches_keep_every_row_in_budget(spark, docs, odd, empty):
    one_id = docs.select(F.lit(3).cast("long").alias("doc_id"), "text").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    for d, salt in ((docs, 4096), (docs, 16), (odd, 4096), (odd, 2), (one_id, 8)):
        got = packing.pack(d, packing.words(), 4, 2000, salt).toPandas()
        assert len(got) == d.count() and (got.padding >= 0).all() and not got.duplicated(["batch_id", "row_in_batch"]).any()
        one = got.groupby("batch_id").agg(n=("doc_id", "size"), length=("bucket_len", "max"), kinds=("bucket", "nunique"))
        assert (one.kinds == 1).all() and ((one.n * one.length <= 2000) | (one.n == 1)).all() and set(one.index) == set(range(len(one)))
        short = got.groupby("bucket").apply(lambda g: (g.groupby("batch_id").size() < g.groupby("batch_id").size().max()).sum(), include_groups=False)
        assert (short <= 1).all()
    assert packing.pack(empty, packing.words()).count() == 0


# 4 chat


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", ">", "s", "/", "[INST]", "[/INST]", "<|end|>", "<|says|>", "</s>", "<s>", "<<SYS>>", "é", "\n", "🙂"]), max_size=12))
def test_texts_come_back_from_the_template(spark, pieces):
    text = "".join(pieces)
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    r = chats.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"), "formatted").first()
    assert [(x.role, x.text) for x in r.t] == [("user", text), ("assistant", text)] and r.l == [text]
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", re.sub(r"<\|\w+\|>", "", r.formatted))


def test_typed_parts(spark):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part("text", text="see <|image:0|> "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.01), part("document", ref="c.pdf", pages=3), part(None, text="end")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (None, None, None, [])], f"conv_id long, turn long, role string, parts {chat.PART}".replace("parts struct", "parts array<struct") + ">")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].formatted == "<|turn|>user<|says|>see <\\|image:0|> <|image:1|><|audio:2|><|document:3|>end<|end|><|turn|>assistant<|says|><|end|>"
    assert [(a.position, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 1200)]
    assert got[1].n_tokens == 2 + 3 + 26 + 1200 + 1 and got[None].n_turns == 1 and chat.format_chats(df.where("false")).count() == 0


def test_texts_of_one_turn_do_not_join_up(spark):
    pieces = ["<", "", "|end|>", None, "<<S", "YS>>\\", "\\", "[/", "INST]", "<", "/s>"]
    parts = [(None, x, None, None, None, None, None) for x in pieces]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    chats = chat.format_chats(df)
    r = chats.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"), "formatted").first()
    text = "".join(x or "" for x in pieces)
    assert [(x.role, x.text) for x in r.t] == [("assistant", text)] and r.l == [text]
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", r.formatted)


def test_op4_contract(spark):
    said = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, _, role, text in sorted(said):
        a, b = want.setdefault(c, ([], []))
        a.append(f"{role}\n{text}\n")
        b += [text] * (role == "assistant")
    digest = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
    for r in queries.op4_chat(spark, SF).collect():
        a, b = want.pop(r.conv_id)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(a), digest(a), len("".join(b)), digest(b))
    assert not want


# 5 language


def test_language_of_held_out_documents(spark, docs):
    got = queries.op5_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        code = langid.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else code.shape[1] // 4)
        assert (np.abs(code.sum(0)) < n).all()


def _decide_brute(model, text):
    """Bits from n-grams one by one, then the loss of every codeword."""
    low, n = " " + text.lower() + " ", [0] * langid.SLOTS
    mask = (1 << 32) - 1
    for i in range(len(low) - 1):
        two = (ord(low[i]) * 0x9E3779B1 + ord(low[i + 1]) * 0x85EBCA6B) & mask
        n[((two * 0x2C1B3C6D) & mask) >> 19] += 1
        if i + 2 < len(low):
            three = (two * 0xC2B2AE35 + ord(low[i + 2]) * 0x27D4EB2F) & mask
            n[((three * 0x165667B1) & mask) >> 19] += 1
    total, loss = sum(n), {}
    for lang, word in zip(model.languages, model.code, strict=True):
        loss[lang] = 0.0
        for b, bit in enumerate(word):
            z = sum(c * model.weights[s, b] for s, c in enumerate(n) if c) / total * math.sqrt(min(total, 400)) * model.slope[b] + model.offset[b]
            loss[lang] += model.trust[b] * math.log1p(math.exp(-bit * z)) if -bit * z < 500 else model.trust[b] * -bit * z
    best = min(loss, key=loss.get)
    return best, 1 / sum(math.exp(loss[best] - x) for x in loss.values())


def test_decoding_by_an_independent_decoder(spark, docs, rows):
    model, texts = langid.train_on_documents(docs), dict(rows)
    got = {r.doc_id: r for r in queries.op5_langid(spark, SF).collect()}
    for i, text in [x for x in texts.items() if len(x[1]) < 4000][:40]:
        want = _decide_brute(model, text) if any(unicodedata.category(c)[0] == "L" for c in text) else ("und", 0.0)
        assert got[i].lang_pred == want[0] and got[i].score == pytest.approx(want[1], abs=1e-6)


def test_numbers_are_no_letters():
    model = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.SLOTS, 1)), np.ones(1), np.zeros(1), np.ones(1))
    for text in ("½ ² ①", "Ⅷ", "123 ½", "", None, "_ 7 ٣", "🙂"):
        assert model.decide(text)[0] == "und"
    assert all(model.decide(t)[0] != "und" for t in ("½ é", "ʰ", "ª", "漢"))


def test_very_many_languages(spark):
    rows = [(f"l{i:03}", f"{chr(0x4E00 + 7 * i) * 3} {chr(0x4E00 + 7 * i + 1) * 2}", 10 * i + k) for i in range(520) for k in range(3)]
    df = spark.createDataFrame(rows, "lang string, text string, doc_id long")
    model = langid.train(df, F.col("lang"), F.col("text"), F.col("doc_id"), 50)
    got = langid.identify(df, model).select("lang", "lang_id.lang_pred").toPandas()
    assert len(model.languages) == 520 and (got.lang_pred == got.lang).mean() > 0.9


def test_language_edges(odd, empty):
    model = langid.train_on_documents(odd)
    got = {(r.doc_id, r.lang_id.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got
    none = langid.train_on_documents(empty)
    assert {r.lang_id.lang_pred for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(empty, none).count() == 0


# 6 fingerprints


def test_op6_contract(spark, rows):
    got = {r.doc_id: r for r in queries.op6_fingerprint(spark, SF).collect()}
    for k, (i, a) in enumerate(rows):
        b, h = rows[(k + 1) % len(rows)][1], len(a) // 2
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest()
    by_text = {}
    for i, a in rows:
        assert by_text.setdefault(a, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_tree_by_hand_and_its_branches(spark):
    df = spark.createDataFrame([("One. Two!\nThree\n\nFour", "One. Two!\nThree x\n\nFour")], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    p1, p2, p3, p4 = [h("One."), h(" Two!"), h("\n")], [h("Three\n")], [h("\n")], [h("Four")]
    s1, s2 = h(h(*p1), h(*p2), h(*p3), h()), h(h(*p4))  # a section that ends with a line end has an empty paragraph after it
    r = df.select("fa", merkle.differing_paragraphs("fa", "fb").alias("d"), merkle.differing_paragraphs("fa", "fa").alias("e"), merkle.likeness("fa", "fb").alias("l"), merkle.likeness("fa", "fa").alias("m")).first()
    assert r.fa.split(":")[0] == h(s1, s2) and r.fa.split(":")[2] == ",".join(x[:8] for x in (*p1, *p2, *p3, *p4))
    assert [(x.section, x.paragraph) for x in r.d] == [(0, 1)] and r.e == [] and r.m == 1 and 0 < r.l < 1


def test_next_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_BUCKET", 3)
    ids = [None, 5, 5, -9, 100, 101, 102, 103, 7, 8, 9, 10, 10**12, 3, 4]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.text: r.nxt for r in merkle.with_next(df, "doc_id", {"text": "nxt"}).collect()}
    order = [t for _, t in sorted(((-(1 << 63) if i is None else i), f"t{k}") for k, i in enumerate(ids))]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_fingerprint_edges(odd, empty):
    rows = merkle.fingerprints_with_edits(odd).collect()
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in odd.collect())
    want = [hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for (_, a), (_, b) in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert sorted(r.edited_sha256 for r in rows) == sorted(want) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert merkle.fingerprints_with_edits(empty).collect() == []
    clash = odd.withColumns({c: F.lit(c) for c in ("_tree", "_key", "_bucket", "_first", "_own", "_to", "_at")})
    for r in merkle.with_next(merkle.with_fingerprint(clash, "text", "f"), "doc_id", {"f": "g"}).collect():
        assert [r[c] for c in ("_tree", "_key", "_bucket", "_first", "_own", "_to", "_at")] == ["_tree", "_key", "_bucket", "_first", "_own", "_to", "_at"]


# 7 token ids


def _encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_matrix.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=token_matrix.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab.,'s1é🙂  ", max_size=30))
def test_ids_are_the_tokenizers(text):
    assert token_matrix.encoder(token_matrix.VOCABULARY).ids(text).tolist() == _encoding_cached().encode_ordinary(text)


_held = []


def _encoding_cached():
    if not _held:
        _held.append(_encoding())
    return _held[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_decreasing(lengths):
    bins = token_matrix.best_fit_decreasing(lengths, 20)
    free, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(f, k) for k, f in enumerate(free) if f >= lengths[i]]
        if fits:
            k = min(fits)[1]
        else:
            free.append(20)
            want.append(0)
            k = len(free) - 1
        free[k] -= lengths[i]
        want[k] += lengths[i]
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and sorted(sum(lengths[i] for i in b) for b in bins) == sorted(want)


def test_matrix_loses_no_token(odd, empty, docs):
    enc = _encoding_cached()
    for d, length in ((odd, 64), (docs, 512)):
        parts = {}
        for r in token_matrix.pack_tokens(d, length, group_tokens=5000).collect():
            ids = np.frombuffer(r.ids, "<u2")
            assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
            for k in range(r.n_segments):
                parts.setdefault(r.doc_ids[k], []).append((r.doc_offsets[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
        total = sum(len(p) for own in parts.values() for _, p in own)
        assert total == sum(len(enc.encode_ordinary(r.text or "")) + 1 for r in d.select("text").collect())
        for r in d.where("doc_id IS NOT NULL AND doc_id <> 2").collect():
            assert sum((p for _, p in sorted(parts[r.doc_id])), []) == [*enc.encode_ordinary(r.text or ""), 50256]
    assert token_matrix.pack_tokens(empty).count() == 0


# 8 token counts


def _greedy(word, first, rest):
    """Longest match first, pieces built; a word that cannot be covered is one token."""
    for j in range(len(word), -1, -1):
        if word[:j] in first:
            break
    else:
        return 1
    n, i = 1, j
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in rest), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=0, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=5), max_size=10), st.text("abcd", min_size=1, max_size=12))
def test_automaton_is_greedy_matching(first, rest, word):
    f, r = {x.encode() for x in first}, {x.encode() for x in rest}
    assert token_counts.Automaton(sorted(f), sorted(r)).count(word.encode()) == _greedy(word.encode(), f, r)


def test_counts_of_documents(spark, rows):
    f, r = map(set, token_counts.read_vocabulary())
    known = {}
    one = lambda w: known.setdefault(w, _greedy(w, f, r))
    for x in queries.op8_token_counts(spark, SF).where("doc_id < 60").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", dict(rows)[x.doc_id]) if w]
        assert (x.n_words, x.n_tokens) == (len(words), sum(one(w.encode()) for w in words))


def test_count_edges(odd, empty):
    a = token_counts.Automaton(*token_counts.read_vocabulary())
    got = {(r.doc_id, r.counted.n_words) for r in token_counts.with_token_counts(odd, a).collect()}
    assert {(3, 0), (4, 0), (5, 0), (6, 60_000)} <= got and token_counts.with_token_counts(empty, a).count() == 0


# 9 Jaccard join


def _sets(texts, width=5):
    out = {}
    for i, t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def _closure(sets):
    top = {i: i for i in sets}
    find = lambda i: i if top[i] == i else find(top[i])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _check_components(df, texts):
    sets = _sets(texts)
    want = _closure(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_components_of_documents(docs, rows):
    _check_components(docs, rows)


def _hot_texts(n, edits=4, seed=5):
    """Groups of near copies and a passage in every other text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, bases, texts = [word() for _ in range(30)], [[word() for _ in range(60)] for _ in range(3)], []
    for i in range(n):
        base = list(bases[i % 3]) if i % 13 < 9 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, edits)):
            base[rng.randrange(len(base))] = word()
        at = rng.randrange(len(base))
        texts.append((i, " ".join(base[:at] + passage * (i % 2) + base[at:])))
    return texts


@pytest.mark.parametrize("limits", [{}, {"LIST_PART": 5, "BLOCK_TOKENS": 900}, {"PAIR_SIZE": 40, "LIST_PART": 60}, {"PAIR_SIZE": 0, "BLOCK_TOKENS": 2000}])
def test_components_of_hot_groups(spark, monkeypatch, limits):
    """Token classes that make pairs of frequent tokens do the work, long lists in parts, groups in several blocks."""
    texts = _hot_texts(260)
    monkeypatch.setattr(jaccard, "_level", lambda c: np.minimum(255, np.asarray(c, float) // 4).astype(np.uint8))
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets, got = _sets(texts), {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, pair_size=jaccard.PAIR_SIZE).collect()}
    want = _closure(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets} and len(set(want.values())) > 60


def test_components_of_many_near_copies(spark):
    """2,000 near copies of one text, some too far from all others: rows of the steps stay of the order of the members."""
    texts = [(i, t) for i, t in _hot_texts(2600, 6, 9) if i % 13 < 9][:2000]
    _check_components(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_lists_keep_every_pair_that_may_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 25))).astype(np.uint64)]) for _ in range(90)]
    size, bits = np.array([len(x) for x in sets]), jaccard.Bitmaps([jaccard.bitmap(x) for x in sets])
    for _ in range(20):
        comp = rng.integers(0, 60, 90)
        lists = [rng.choice(90, int(rng.integers(2, 70)), replace=False) for _ in range(6)]
        label = jaccard.list_labels(np.concatenate(lists), np.array([len(x) for x in lists]), size, comp, bits, 80, 100)
        assert (label[label] == label).all() and (label <= np.arange(90)).all()
        for members in lists:
            for a in members:
                for b in members:
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if comp[a] != comp[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        assert label[a] == label[b]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    sets = [pool[rng.random(len(pool)) < share] for share in (0.02, 0.1, 0.1, 0.11, 0.5, 0.52, 0.9, 0.95, 1.0)]
    bits = jaccard.Bitmaps([jaccard.bitmap(x) for x in sets])
    tight = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if 2 * min(len(x), len(y)) > max(len(x), len(y)):
                differ, least = len(np.setxor1d(x, y)), int(bits.apart(np.array([i]), np.array([j]))[0])
                assert least <= differ and (i != j or least == 0)
                tight += least > 0.6 * differ > 0
    assert tight > 10


def test_joining_links_close_like_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(40) < 0.92], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]) for _ in range(70)]
    comp, side = rng.integers(0, 50, 70), rng.integers(0, 3, 70)
    linked = lambda i, j: 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)
    pairs = [(i, j) for i in range(70) for j in range(70) if side[i] and side[j] != 1 and comp[i] != comp[j] and linked(i, j)]
    got = jaccard.joining_links(sets, comp, side, 80, 100)
    kinds = np.unique(comp, return_inverse=True)[1]
    close = lambda links: jaccard.label_edges(50, np.array([kinds[i] for i, _ in links]), np.array([kinds[j] for _, j in links])).tolist()
    assert pairs and set(got) <= set(pairs) and len(got) < 50 and close(got) == close(pairs)


@pytest.mark.parametrize("pair_size", [0, 20, 35, 1000])
def test_prefixes_of_similar_sets_meet(pair_size):
    rng = np.random.default_rng(6)
    levels = np.zeros(1 << 16, np.uint8)
    levels[rng.random(len(levels)) < 0.7] = 9
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = rng.choice(len(a), min(len(a) - 1, int(rng.integers(0, len(a) // 5 + 1))), replace=False)
        b = np.unique(np.r_[np.delete(a, drop), rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 8 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(a) > 1 and len(b) > 1 and 100 * both >= 80 * (len(a) + len(b) - both):
            keys = [jaccard.prefix_keys(x, levels, 5, 80, 100, pair_size)[0] for x in (a, b)]
            assert len(np.intersect1d(*keys)) and max(map(len, keys)) <= max(n, (pair_size // 5 + 2) ** 2)


def test_jaccard_edges(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert {(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (None, 0, None)} <= set(got) and len(got) == 10
    assert jaccard.jaccard_components(empty).count() == 0
    assert {r.doc_id for r in jaccard.keep_one_of_each(odd).collect()} == {1, 3, 4, 5, 6, 7, None}


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 90), (None, 3), (100, 90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90}


def test_connected_hubs(spark):
    """Nodes with very many neighbours: one larger than all of them, one smaller, and a random graph."""
    rng = random.Random(8)
    edges = [(5000, i) for i in range(1, 900)] + [(1000, i) for i in range(1001, 1900)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)]
    top = {i: i for e in edges for i in e}
    find = lambda i: i if top[i] == i else find(top[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    linked = {i for a, b in edges if a != b for i in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in linked}


def test_shingles_are_the_definition():
    for text in ("", None, " a ", "A b C", "a b c d e", "a b c d e f a b c d e", "É é x\x0by\x0cz w v u t"):
        assert len(shingle_set(text)) == len(_sets([(0, text)])[0])
    assert (shingle_set("A B c D e") == shingle_set("a b C d\ne")).all() and (shingle_set("É") != shingle_set("é")).all()


# 10 licenses


def test_alignment_keeps_order():
    pairs = licenses.align("a b c d e f".split(), "x a b q d e e f y".split())
    assert [i for i, _ in pairs] == sorted(i for i, _ in pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs) and len(pairs) == 5
    assert licenses.rising([3, 1, 2, 9, 4]) == [1, 2, 4]


def _common(a, b):
    """Length of the longest common subsequence, by its table."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j] + 1 if x == y else 0, row[j + 1], 0) for j, y in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14), st.lists(st.integers(0, 12), max_size=14))
def test_alignment_against_the_longest_common_subsequence(a, b):
    """Equal words in order; all that can be had where no word repeats; anchors alone where every word is unique."""
    a, b = [str(x) for x in a], [str(x) for x in b]
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) <= _common(a, b)
    once, also = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    assert len(licenses.align(once, also)) == _common(once, also)


def test_versions_and_kinds_are_told_apart(spark, tmp_path):
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-NC-SA-4.0", "CC-BY-4.0-notice", "CC-BY-SA-4.0-notice"):
        text = f"some words before it. {licenses.TEMPLATES[name]} And after."
        assert [(x[0], x[1]) for x in scan(text)] == [(name, 1.0)]
    (tmp_path / "Own-1.0.txt").write_text("Everyone may do with this text\nwhatever they like.")
    own = licenses.Scanner(licenses.read_templates(spark, str(tmp_path)))
    assert [x[0] for x in own.scan("x y everyone may do with this text whatever they like z")] == ["Own-1.0"]
    with pytest.raises(ValueError, match="bytes"):
        licenses.read_templates(spark, str(tmp_path), 10)


def test_licenses_of_documents(spark, rows):
    text = "|".join(re.escape(licenses.TEMPLATES[k].rstrip(".")) for k in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"))
    want = {(d, m.start(), m.end()) for d, t in rows for m in re.finditer(text, t)}
    got = {(r.doc_id, r.start, r.end) for r in queries.op10_licenses(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 1


def test_license_with_edits_and_twice(odd, empty):
    words = licenses.TEMPLATES["MIT-text"].split()
    changed = " ".join(w if i % 12 else "other" for i, w in enumerate(words))
    found = licenses.Scanner(licenses.TEMPLATES).scan(f"start here {changed} and then {changed} done")
    assert [x[0] for x in found] == ["MIT-text", "MIT-text"] and all(0.85 < x[1] < 1 for x in found)
    assert licenses.scan_licenses(odd).where("size(licenses) > 0").count() == 0 and licenses.scan_licenses(empty).count() == 0


# pipeline


def test_pipeline_stages_against_brute_force(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "decontamination", "packing"]
    texts, meta = dict(rows), {r.doc_id: r for r in docs.collect()}
    told, model = stages["language_id"](spark, docs, SF), langid.train_on_documents(docs)
    kept = {i for i, t in texts.items() if (d := model.decide(t))[0] != "und" and d[1] >= corpus_pipeline.LANGUAGE_SCORE}
    assert told.columns == docs.columns and {r.doc_id for r in told.collect()} == kept and len(kept) > 0.97 * len(rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judge = quality.train(docs, labels, quality.good())
    want = {i for i, r in meta.items() if judge.score(r.text, r.source, r.lang, r.n_chars)[2] >= 0.5}
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want and 0.5 * len(rows) < len(want) < len(rows)
    one = stages["near_duplicates"](spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, c in _closure(_sets(rows)).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in rows if not _leaks_brute(items, t)}
    packed = {tuple(r) for r in stages["packing"](spark, docs, SF).collect()}
    assert packed == {tuple(r) for r in queries.op3_packing(spark, SF).collect()}  # that is held against brute force above
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    more = odd.withColumns({"judged": F.lit("j"), "component_id": F.lit(5), "n_tokens": F.lit(6)})
    want = {"language_id": [1, 2, 2, 6, 7, None], "near_duplicates": [1, 3, 4, 5, 6, 7, None, None], "decontamination": [1, 2, 2, 3, 4, 5, 6, 7, None, None]}
    ids = lambda found: sorted((r.doc_id for r in found), key=lambda i: (i is None, i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, more, SF).collect()
        assert all((r.judged, r.component_id, r.n_tokens, r.lang_id, r.leaks) == ("j", 5, 6, 5, 6) for r in found)
        assert set(ids(found)) <= {1, 2, 3, 4, 5, 6, 7, None} and (name not in want or ids(found) == want[name])
        assert stage(spark, empty, SF).collect() == [] and stage(spark, empty, SF).columns == empty.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, more, SF)
    assert ids(packed.collect()) == ids(odd.collect()) and corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []
