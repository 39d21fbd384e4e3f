"""Benchmark decontamination by BM25 and block-max WAND (operator 2).

The benchmark items are the indexed collection, every passage (window of words) of every training text is a query.
Scores are divided by an item's score with itself, so that 1 means that all its words occur. A passage is twice as long
as the longest item of its class, and passages start every half passage, so that an item that stands whole in a text
stands whole in a passage. An item's class depends on its own length alone, its scores on the statistics of the whole
benchmark, its question and answer on its whole text: how items are dealt over shards changes nothing.

For each passage, WAND runs over the posting lists of a shard. Its opening questions, whether the lists of all the
passage's words, and then any block of items in them, could reach the threshold, are asked for many passages at once
with sums of the maxima.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

K1, B = 1.2, 0.75
#: Items of one shard, about: what a task holds of the index at a time.
SHARD_ITEMS = 256
#: Items of one block: few, so that a block's bound is near its items' scores.
BLOCK = 4
#: Words of the shortest passages. An item of n words is sought in passages of the least of PASSAGE * 2**k that is 2 n at least.
PASSAGE = 64
#: Bytes of the shards that are sent out together.
PORTION_BYTES = 64 << 20
#: Characters, about, of the texts that are held against a portion together.
TEXT_CHARS = 2_000_000
#: Where there are several portions: characters, about, of the texts for which each portion is read once.
HELD_CHARS = 32_000_000
#: Rows that are gathered at most, however short their texts are.
HELD_ROWS = 100_000
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's last sentence is its answer; of an item of one sentence, the last quarter of its words."""
    ends = list(_SENTENCE_END.finditer(text))
    if ends and split_words(text[ends[-1].end() :]) and split_words(text[: ends[-1].end()]):
        return split_words(text[: ends[-1].end()]), split_words(text[ends[-1].end() :])
    words = split_words(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """The n-grams of words; of fewer words, all of them as one."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def passage_words(n_words: int) -> int:
    """Words of the passages in which an item of ``n_words`` is sought."""
    return max(PASSAGE, 1 << (2 * n_words - 1).bit_length())


def impacts_of(words: list[str], df: dict[str, int], n_items: int, mean_words: float) -> dict[str, float]:
    """BM25 weight of every word of an item, as a share of the item's sum."""
    own: dict[str, float] = {}
    for w in words:
        own[w] = own.get(w, 0) + 1
    for w, tf in own.items():
        d = df.get(w, 1)
        own[w] = float(np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / max(mean_words, 1))))
    total = sum(own.values())
    return {w: x / total for w, x in own.items()}


class Index:
    """Postings of one shard: for each term, items in order, impacts, and the largest impact in each block of items."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_words: float, passage: int):
        self.passage, self.n, self.ids = passage, len(items), [i for i, _ in items]
        self.blocks = -(-self.n // BLOCK)
        self.terms: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = [[]]
        for i, (_, text) in enumerate(items):
            for w, x in impacts_of(split_words(text), df, n_items, mean_words).items():
                t = self.terms.setdefault(w, len(self.terms) + 1)
                if t == len(lists):
                    lists.append([])
                lists[t].append((i, x))
        self.items = [[i for i, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.top = [max(p, default=0.0) for p in self.impacts]
        self.peaks = np.array(self.top)
        bounds = np.zeros((len(lists), max(self.blocks, 1)))
        for t, p in enumerate(lists):
            for i, x in p:
                bounds[t, i // BLOCK] = max(bounds[t, i // BLOCK], x)
        rounded = bounds.astype(np.float32)
        self.bounds = np.where(rounded < bounds, np.nextafter(rounded, np.float32(2)), rounded)  # never below the maxima
        self.parts = [question_and_answer(text) for _, text in items]
        self.grams = [tuple((grams(p, min(3, max(len(p), 1))), min(3, max(len(p), 1))) for p in parts) for parts in self.parts]

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with at least ``threshold``, for distinct terms."""
        stop = self.n
        cursors = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.top[t]
                if total + 1e-9 >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.bounds[c[2], block]) for c in cursors[: pivot + 1]) + 1e-9 >= threshold:
                if cursors[0][0] == item:
                    s = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if s + 1e-9 >= threshold:
                        found.append((item, s))
                    target, move = item + 1, range(pivot + 1)
                else:
                    target, move = item, [k for k in range(pivot + 1) if cursors[k][0] < item]
            else:  # no item of this block can reach it, up to the next cursor's item
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target, move = max(target, item + 1), range(pivot + 1)
            for k in move:
                c = cursors[k]
                c[1] = bisect.bisect_left(self.items[c[2]], target, c[1])
                c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else stop
            cursors = [c for c in cursors if c[0] < stop]
        return found

    def hopeful(self, ids: np.ndarray, lengths: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(text, passage) of the passages in which the bound of some block reaches the threshold.

        ``ids`` are the words of all texts, ``lengths`` how many each text has. Largest impacts are added over each half
        passage alone, first those of whole lists, then those of blocks where the former suffice. An error of single
        precision is at most that of ``step`` additions of positive numbers, which the latter are raised by.
        """
        step, kinds = self.passage // 2, len(self.bounds)
        halves = np.maximum(1, -(-lengths // step))
        base = np.cumsum(halves + 1) - halves - 1  # an empty half follows every text
        at = np.flatnonzero(ids)
        if not len(at):
            return
        half = (at + np.repeat(base * step - np.cumsum(lengths) + lengths, lengths)[at]) // step
        keys = np.sort(half * kinds + ids[at])
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]  # a word counts once in a half passage
        half = keys // kinds
        words = keys - half * kinds
        sums = np.bincount(half, self.peaks[words], int(base[-1] + halves[-1]) + 2)
        live = np.flatnonzero(sums[:-1] + sums[1:] + 1e-9 >= threshold)
        text = np.searchsorted(base, live, "right") - 1
        live = live[live - base[text] < np.maximum(1, halves[text] - 1)]
        needed = np.zeros(len(sums), bool)
        needed[live] = needed[live + 1] = True
        place = np.cumsum(needed) - 1
        half, words = half[needed[half]], words[needed[half]]
        for part in np.array_split(live, (len(live) * step * self.bounds.shape[1] >> 20) + 1):  # texts of any length in bounded memory
            first, last = np.searchsorted(half, [part[0], part[-1] + 2]) if len(part) else (0, 0)
            if first == last:
                continue
            low = place[part[0]]
            own = place[half[first:last]] - low
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            bounds = np.zeros((place[part[-1] + 1] - low + 1, self.bounds.shape[1]), np.float32)
            bounds[own[starts]] = np.add.reduceat(self.bounds[words[first:last]], starts, axis=0)
            best = (bounds[place[part] - low] + bounds[place[part + 1] - low]).max(1).astype(float) * (1 + (step + 2) * 2.0**-23)
            found = part[best + 1e-9 >= threshold]
            text = np.searchsorted(base, found, "right") - 1
            yield from zip(text.tolist(), (found - base[text]).tolist(), strict=True)

    def search(self, texts: list[list[str]], ids: np.ndarray, lengths: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, tuple[int | None, float, float, float]]]:
        """(text, (item id, score, question overlap, answer overlap)) of the items that texts hold; the best of an item's passages."""
        if not self.n:
            return
        step, starts = self.passage // 2, np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for i, k in self.hopeful(ids, lengths, threshold):
            words, lo, hi = texts[i], k * step, min(k * step + self.passage, len(texts[i]))
            terms = np.unique(ids[starts[i] + lo : starts[i] + hi])
            terms = terms[terms > 0]
            if float(self.bounds[terms].sum(0, dtype=np.float64).max()) + 1e-9 < threshold:  # the same bound, of distinct words
                continue
            hits = self.above(terms.tolist(), threshold)
            near = words[max(0, lo - step) : hi + step]
            held = {n: grams(near, n) for n in (1, 2, 3)} if hits else {}
            for item, s in hits:
                q, a = (len(g & held[n]) / len(g) if g else 1.0 for g, n in self.grams[item])
                if q >= overlap and a >= overlap:
                    best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (float(s), q, a))
        for (i, item), x in sorted(best.items()):
            yield i, (self.ids[item], *x)

    def leaks(self, words: list[str], threshold: float, overlap: float) -> list[tuple[int | None, float, float, float]]:
        """The items that one text holds."""
        return Portion([self]).leaks([words], threshold, overlap)[0]


class Portion:
    """Shards that a task holds at a time; a word is looked up once for all of them."""

    def __init__(self, shards: list[Index]):
        self.shards, self.terms = shards, {}
        self.places = [np.array([self.terms.setdefault(w, len(self.terms) + 1) for w in shard.terms], np.int64) for shard in shards]

    def leaks(self, texts: list[list[str]], threshold: float, overlap: float) -> list[list[tuple[int | None, float, float, float]]]:
        """(item id, score, question overlap, answer overlap) of the items that each text holds."""
        lengths = np.array([len(w) for w in texts], np.int64)
        ids = np.fromiter(map(self.terms.get, itertools.chain.from_iterable(texts), itertools.repeat(0)), np.int32, int(lengths.sum()))
        found: list[list[tuple[int | None, float, float, float]]] = [[] for _ in texts]
        for shard, places in zip(self.shards, self.places, strict=True):
            own = np.zeros(len(self.terms) + 1, np.int32)
            own[places] = np.arange(1, len(places) + 1)  # a shard numbers its terms in order
            for i, leak in shard.search(texts, own[ids], lengths, threshold, overlap):
                found[i].append(leak)
        return found


@dataclass
class Benchmark:
    """An index, sent out in portions of bounded size; a task holds one portion at a time."""

    portions: list[Broadcast]

    def read(self) -> Iterator[Portion]:
        for portion in self.portions:
            yield Portion([pickle.loads(shard) for shard in pickle.loads(portion.value)])
            if len(self.portions) > 1 and getattr(portion, "_path", None):  # a worker would keep the bytes of all portions read
                vars(portion).pop("_value", None)


def build(items: DataFrame, shard_items: int = SHARD_ITEMS, portion_bytes: int = PORTION_BYTES) -> Benchmark:
    """Index ``items(item_id, text)``; document frequencies cover all items.

    Items with a null text or without words are left out. Equal rows are kept once; several texts of one id are items of
    their own, and so are texts without an id. Other columns are not read; an empty table gives an index without items.
    Shards of about ``shard_items`` items are built in tasks of their own and pass the driver in portions.
    """
    spark = items.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(t) for t in batch.column(1).to_pylist()]
            kinds = pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
            sizes, passages = pa.array([len(w) for w in words], pa.int64()), pa.array([passage_words(len(w)) for w in words], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), kinds, sizes, passages], ["item_id", "text", "kinds", "n", "passage"])

    kept = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    kept = materialize(kept.mapInArrow(split, "item_id long, text string, kinds array<string>, n long, passage long").where("n > 0"), "items")
    total = kept.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    n_items, mean_words = total["n"], (total["words"] or 0) / max(total["n"], 1)
    in_class = kept.groupBy("passage").agg(F.ceil(F.count("*") / F.lit(float(shard_items))).alias("shards"))
    placed = kept.join(in_class, "passage").withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.col("shards")))
    terms = placed.select("passage", "shard", F.explode("kinds").alias("term"))
    df = kept.select(F.explode("kinds").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    told = materialize(terms.distinct().join(df, "term"), "terms")

    def index(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        own = sorted(((None if pd.isna(i) else int(i), t) for i, t in zip(rows["item_id"], rows["text"], strict=True)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shard = Index(own, dict(zip(counts["term"], counts["df"].tolist(), strict=True)), n_items, mean_words, int(rows["passage"].iloc[0]))
        return pd.DataFrame({"shard": [pickle.dumps(shard)]})

    by = ["passage", "shard"]
    shards = materialize(placed.select(*by, "item_id", "text").groupBy(*by).cogroup(told.groupBy(*by)).applyInPandas(index, "shard binary"), "shards")
    portions, held, size = [], [], 0
    for row in itertools.chain(shards.toLocalIterator(), [None]):  # the driver holds one portion at a time
        if held and (row is None or size + len(row["shard"]) > portion_bytes):
            portions.append(spark.sparkContext.broadcast(pickle.dumps(held)))
            held, size = [], 0
        if row is not None:
            held.append(bytes(row["shard"]))
            size += len(row["shard"])
    return Benchmark(portions)


def _runs(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ends of runs of texts that hold about ``chars`` characters."""
    size = np.cumsum([len(t or "") for t in texts]) // chars
    yield from itertools.pairwise([0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)])


def _gathered(parts: Iterator[pd.Series], chars: int) -> Iterator[list[str | None]]:
    """The texts of batches, joined over batches until they hold ``chars`` characters or ``HELD_ROWS`` rows."""
    held, size = [], 0
    for part in parts:
        held += part.tolist()
        size += sum(len(t or "") for t in held[len(held) - len(part) :])
        if size >= chars or len(held) >= HELD_ROWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks_of(parts: Iterator[pd.Series], benchmark: Benchmark, threshold: float, overlap: float) -> Iterator[list[list[tuple]]]:
    """The leaks of each text of a partition, in order.

    An index of one portion is read once. Of a larger one each portion is read once for ``HELD_CHARS`` characters or
    more, up to twice as many (or one text), whose words a task then keeps, equal ones as one string.
    """
    several = len(benchmark.portions) > 1
    small = None if several else list(benchmark.read())
    for texts in _gathered(parts, HELD_CHARS if several else 1):
        found: list[list[tuple]] = []
        total = sum(len(t or "") for t in texts)
        for lo, hi in _runs(texts, total // max(1, total // HELD_CHARS) + 1 if several else TEXT_CHARS):
            split, same = map(split_words, texts[lo:hi]), {}  # a text is split once for all shards
            words = [list(map(same.setdefault, own, own)) for own in split] if several else list(split)
            runs = list(_runs(texts[lo:hi], TEXT_CHARS))
            leaks: list[list[tuple]] = [[] for _ in words]
            for portion in benchmark.read() if small is None else small:
                for a, b in runs:
                    for held, more in zip(leaks[a:b], portion.leaks(words[a:b], threshold, overlap), strict=True):
                        held += more
            found += leaks
        yield found


def find_leaks(docs: DataFrame, benchmark: Benchmark, threshold: float = 0.5, overlap: float = 0.5, out: str = "leaks") -> DataFrame:
    """``docs`` with an array ``out`` of structs (item_id, score, question_overlap, answer_overlap), empty for clean texts.

    Only ``text`` is read, and read whole; null counts as empty. Repeated rows get equal answers, an empty table gives
    an empty one; other columns stay as they are, one with the name ``out`` is replaced.
    """
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    @F.pandas_udf("array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        order = lambda x: (x[0] is None, x[0] or 0, -x[1])
        for found in leaks_of(texts, benchmark, threshold, overlap):
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in sorted(own, key=order)] for own in found])

    return docs.withColumn(out, search(F.col("text")))
