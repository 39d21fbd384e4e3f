"""Operator 13 against the definition, its state against itself after deletions, and the filter against sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from extremes.llm import queries
from extremes.llm.line_store import CuckooFilter, LineStore

SPACE = " \t\n\x0b\x0c\r"


def bare(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def definition(docs, least=10):
    """{doc_id: (kept, n_lines, n_dropped)} of distinct ids."""
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(bare(line), set()).add(i)
    gone = lambda i, line: len(k := bare(line)) >= least and min(holders[k]) < i
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def texts(seed, n, first=0):
    rng = random.Random(seed)
    pool = [f"Line number {k} of all" for k in range(30)] + ["short", "", "  padded line here\t", "PADDED LINE HERE", "été à la plage, là", "exactly 10", "nine char"]
    return [(first + i, rng.choice([None, "", "\n"]) if rng.random() < 0.1 else "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 12)))) for i in range(n)]


def made(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def cleaned(store, df):
    return {r.doc_id: tuple(r.cleaned) for r in store.clean(df).collect()}


def state(store):
    """The exact tables and what the filters answer for, as plain values."""
    refs, counts = (Counter(map(tuple, df.collect())) for df in (store.refs, store.counts))
    prints = {}
    for r in store.filters.collect():
        own = CuckooFilter.from_bytes(r["filter"])
        at, slot = np.nonzero(own.table)
        held = [(min(int(b), int(own._other(int(b), own.table[b, s]))), int(own.table[b, s])) for b, s in zip(at, slot)] + own.stash
        if held:
            prints[r.shard] = Counter(held)
    return refs, counts, prints


@pytest.mark.parametrize("shard_keys", [4, 1 << 16])
def test_increments_give_what_the_definition_gives(spark, shard_keys):
    """In one go and in three, in any order of the ids; a store of four keys a shard grows its shards on the way."""
    docs = texts(1, 90)
    df = made(spark, docs)
    want = definition(docs)
    store = LineStore.empty(spark, shard_keys)
    for part in ("doc_id % 3 = 2", "doc_id % 3 = 0", "doc_id % 3 = 1"):
        store = store.insert(df.where(part))
    assert cleaned(store, df) == want
    assert cleaned(LineStore.empty(spark, shard_keys).insert(df), df) == want
    assert (store.shards > 4) == (shard_keys == 4)
    assert store.counts.count() == store.n_keys == sum(len(CuckooFilter.from_bytes(r["filter"])) for r in store.filters.collect())


def test_deletions_take_insertions_back(spark):
    """Tables and filters are those of before; when the smallest holder goes, the next one keeps the line."""
    one, two = texts(2, 60), texts(3, 60, first=-30)
    two = [(i if i < 0 else i + 100, t) for i, t in two]
    a, b = made(spark, one), made(spark, two)
    before = LineStore.empty(spark).insert(a)
    after = before.insert(b)
    back = after.delete(b)
    assert state(back) == state(before) and cleaned(back, a) == definition(one) != cleaned(after, a)
    other = after.delete(a)
    assert cleaned(other, b) == definition(two) and state(other) == state(LineStore.empty(spark).insert(b))
    none = other.delete(b.unionByName(a))
    assert none.n_keys == 0 and none.refs.count() == 0 and sum(len(CuckooFilter.from_bytes(r["filter"])) for r in none.filters.collect()) == 0
    assert state(none.insert(a)) == state(before)
    assert state(before.delete(made(spark, [(10**6, None)]))) == state(before)


def test_a_store_is_saved_and_read(spark, tmp_path):
    docs = texts(4, 40)
    df = made(spark, docs)
    LineStore.empty(spark, 8).insert(df.where("doc_id < 20")).save(str(tmp_path / "s"))
    store = LineStore.load(spark, str(tmp_path / "s")).insert(df.where("doc_id >= 20"))
    assert cleaned(store, df) == definition(docs)


def test_false_alarms_of_the_filter_change_nothing(spark, monkeypatch):
    """A filter that says yes to everything sends all keys to the exact counts, with the same result."""
    docs = texts(5, 50)
    df = made(spark, docs)
    first = LineStore.empty(spark).insert(df.where("doc_id < 25"))
    truth = first.insert(df.where("doc_id >= 25"))
    monkeypatch.setattr(LineStore, "seen", lambda self, keys: keys.withColumn("seen", F.lit(True)))
    assert state(first.insert(df.where("doc_id >= 25"))) == state(truth)


def test_edges(spark):
    long = "\n".join(f"a line with the number {i % 5000}" for i in range(40_000))
    docs = [(1, "shared by both of them\nown"), (2, None), (3, ""), (4, "x\n\n SHARED BY BOTH OF THEM \n"), (5, long), (6, long)]
    df = made(spark, docs).unionByName(made(spark, [(None, "shared by both of them")])).selectExpr("*", "1 AS key", "2 AS shard", "3 AS _keys", "4 AS n")
    store = LineStore.empty(spark).insert(df)
    got = {r.doc_id: tuple(r.cleaned) for r in store.clean(df, out="cleaned").collect()}
    assert got == definition(docs) | {None: ("shared by both of them", 1, 0)}
    assert store.clean(df).columns == [*df.columns, "cleaned"]
    twice = df.unionByName(df)
    assert {r.doc_id: tuple(r.cleaned) for r in LineStore.empty(spark).insert(twice).clean(twice).collect()} == got  # rows of one id are one document
    none = LineStore.empty(spark).insert(df.where("false"))
    assert none.n_keys == 0 and none.clean(df.where("false")).count() == 0 and cleaned(none, df)[4][2] == 0
    assert state(store.insert(df.where("false"))) == state(store)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120), st.integers(1, 40), st.integers(0, 9))
def test_the_filter_never_forgets(names, keys, seed):
    """Small filters that overflow, repeated and colliding hashes, deletions in any order, bytes and back."""
    hashes = lambda xs: np.array([int.from_bytes(hashlib.md5(bytes([x % 7, x])).digest()[:8], "little") for x in xs], np.uint64)
    own, rng = CuckooFilter(keys), random.Random(seed)
    for start in range(0, len(names), 13):
        own.add(hashes(names[start : start + 13]))
    assert len(own) == len(names) and own.contains(hashes(names)).all()
    own = CuckooFilter.from_bytes(own.to_bytes())
    rng.shuffle(names)
    half = len(names) // 2
    own.remove(hashes(names[:half]))
    assert len(own) == len(names) - half and own.contains(hashes(names[half:])).all()
    own.remove(hashes(names[half:]))
    assert len(own) == 0 and not own.contains(hashes(range(50))).any()


def test_false_alarms_are_rare():
    rng = np.random.default_rng(1)
    own = CuckooFilter(1 << 14)
    own.add(rng.integers(0, 1 << 63, 1 << 14).astype(np.uint64))
    assert not own.stash and own.contains(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)).mean() < 3e-4


def test_query_is_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, (kept, n, d) in definition(docs).items()}
    assert {tuple(r) for r in queries.op13_lines(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
