"""Spelling variant grouping by dense prefix-suffix tiling (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one the other. With p and s the code points
that they share at the front and at the end, that is: they differ, their lengths differ by one at most, and p + s
reaches the longer length less one. Steps, all over every word:

1. *Counts*: words are counted where texts are read; a table of (word, n) is all that is shuffled.
2. *Groups*: for near words of lengths m and m + d (d is 0 or 1), p or s is at least ``h = ceil((m + d - 1) / 2)``, so both share the first or
   the last h code points. A word enters six groups, a front and an end for each length that its partner may have.
3. *Tiles*: a group's words, as padded matrices of code points, are compared block by block, each pair of blocks in
   a task of its own where a group has more than one block. A pair that shares front and end counts at the front only.
4. Each tile puts out one row for a word with near words in it: their number and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Runs of letters that are words before ``edit``.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a block, and of a pack of small tiles that share a matrix; fewer where words are so long that their pairs would
#: compare more than some CELLS code points at a time.
BLOCK = 256
PACK = 128
CELLS = 1 << 23
#: Words that a task counts before it puts them out, and code points of a text that it takes at a time.
HELD = 200_000
PIECE = 1 << 20


def drop_every_97th(doc_id: int | None, run: str) -> str:
    """``run`` without one code point if 97 divides the crc32 of ``<doc_id>:<run>``; a planted error, the same on every read."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1 :]


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of ``text``, A-Z as a-z, a piece at a time; no piece ends inside of a run."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            inside = RUN.match(text, end - 1)
            end = inside.end() if inside else end
        yield RUN.findall(text[start:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        start = end


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, edit: Callable[[int | None, str], str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words of ``docs``, of at least ``least_length`` code points and ``least_count`` occurrences.

    ``edit`` may change a run, given its document's key. Null and empty texts have no words; each of repeated rows counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, whole in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                for runs in _runs(whole.as_py() or ""):
                    own.update(runs)
                doc_id = doc_id.as_py()
                for run, n in own.items():
                    word = edit(doc_id, run) if edit else run
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    parts = docs.select(key, text).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _groups(words: DataFrame) -> DataFrame:
    """``(word, n, group, length, d, front)``: the six groups of each word. A group is its lengths, its side and the shared part."""
    size = F.length("word")

    def of(shorter, d: int, half):
        name = lambda side, part: F.struct(F.concat_ws("|", shorter.cast("string"), F.lit(f"{d}{side}"), part).alias("group"), shorter.alias("length"), F.lit(d).alias("d"), F.lit(side == "front").alias("front"))
        return [name("front", F.substring("word", F.lit(1), half)), name("end", F.substring("word", size - half + 1, half))]

    half = F.floor(size / 2).cast("int")
    every = F.array(*of(size, 0, half), *of(size, 1, F.ceil(size / 2).cast("int")), *of(size - 1, 1, half))
    return words.select("word", "n", F.explode(every).alias("g")).select("word", "n", "g.*")


def _tiles(words: DataFrame) -> DataFrame:
    """``(tile, part, word, n)``: words by the pairs of blocks in which they are compared; a group within one block is one tile."""
    grouped = _groups(words)
    block = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.sqrt(F.lit(CELLS) / F.greatest("length", F.lit(1))))))
    large = grouped.groupBy("group", "length").agg(F.count("*").alias("members")).where(F.col("members") > block)
    parts = large.select("group", F.ceil(F.col("members") / block).cast("int").alias("parts"))
    placed = grouped.join(parts, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.concat_ws("|", F.least("part", "other").cast("string"), F.greatest("part", "other").cast("string"), "group")
    return dealt.select(tile.alias("tile"), "part", "d", "front", "word", "n")


def near_pairs(words: np.ndarray, tile: np.ndarray, part: np.ndarray, d: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b, of near words of one tile; words of the two parts of a tile meet each other only.

    ``words`` is an array of fixed-width strings, which is their padded matrix of code points.
    """
    width = max(words.dtype.itemsize // 4, 1)
    points = np.ascontiguousarray(words).view(np.uint32).reshape(len(words), width)
    size = np.char.str_len(words)
    place = size[:, None] - 1 - np.arange(width)
    backwards = np.where(place >= 0, np.take_along_axis(points, np.maximum(place, 0), 1), 0)
    at = np.unique(tile, return_inverse=True)[1]
    low, high = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, -1)
    np.minimum.at(low, at, part)
    np.maximum.at(high, at, part)
    two = (low < high)[at]  # of a tile of two parts
    meet = at[:, None] == at[None, :]
    meet &= np.abs(size[:, None] - size[None, :]) == d[:, None]
    meet &= ~two[:, None] | (part[:, None] != part[None, :])
    a, b = np.nonzero(np.triu(meet, 1))
    # a zero is padding: no code point of a word
    common = lambda of: np.minimum.accumulate((of[a] == of[b]) & (of[a] != 0), axis=1).sum(axis=1)
    fore, aft, longer = common(points), common(backwards), np.maximum(size[a], size[b])
    found = (fore + aft >= longer - 1) & (front[a] | (fore < longer // 2)) & ((fore < longer) | (size[a] != size[b]))
    return a[found], b[found]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> ``(word, n_near, best_n, best)`` of the words with near words, tile by tile; small tiles share a matrix."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        words = np.array(rows["word"].to_pylist(), dtype=str)
        n = rows["n"].to_numpy()
        a, b = near_pairs(words, rows["tile"].to_numpy(), rows["part"].to_numpy().astype(np.int64), rows["d"].to_numpy(), rows["front"].to_numpy(zero_copy_only=False))
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((words[target], -n[target], source))
        source, target = source[order], target[order]
        at, begin, count = np.unique(source, return_index=True, return_counts=True)
        best = target[begin]
        return pa.RecordBatch.from_arrays([pa.array(words[at].tolist(), pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array(words[best].tolist(), pa.string())], ["word", "n_near", "best_n", "best"])

    held: list[pa.Table] = []

    def packs(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Whole tiles of ``rows`` in packs; the last tile, which may go on, is kept back unless it is the ``last``."""
        tiles = rows["tile"].to_numpy()
        ends = [*(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), *([len(tiles)] if last else [])]
        sizes = np.array([len(x) for x in rows["word"].to_pylist()])
        start = stop = widest = 0
        for end in ends:
            wide = int(sizes[stop:end].max())
            if stop > start and (end - start > PACK or (end - start) ** 2 * max(widest, wide) > CELLS):
                yield solve(rows.slice(start, stop - start))
                start, widest = stop, 0
            stop, widest = int(end), max(widest, wide)
        if stop > start:
            yield solve(rows.slice(start, stop - start))
        held[:] = [rows.slice(stop)]

    for batch in batches:
        yield from packs(pa.concat_tables([*held, pa.Table.from_batches([batch])]), False)
    if held and len(held[0]):
        yield from packs(held[0], True)


def nearest_words(words: DataFrame) -> DataFrame:
    """``words(word, n)`` -> ``(word, n_near, best_n, best)`` of words with near words: how many, and the one of largest n (ties: the smallest)."""
    dealt = _tiles(words).repartition("tile").sortWithinPartitions("tile")
    found = dealt.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_variants(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """``words(word, n)``, distinct, -> ``(word, form, root, n, n_near, form_n)``.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least ``ratio``
    times its own; its root is what following forms ends at, itself if it has none. Null words are left out; an empty
    table gives an empty one; words of any length are compared whole. Words must not hold the code point 0.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be over 1: a chain of forms must end")
    counted = materialize(words.where("word IS NOT NULL").select("word", "n"), "words")
    formed = F.col("best_n") >= ratio * F.col("n")
    known = materialize(
        counted.join(nearest_words(counted), "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")),
        "forms",
    )
    ends = counted.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    steps = 1
    while ends["low"] and ends["low"] * ratio**steps < ends["high"]:
        steps += 1  # no chain is longer: n grows by the ratio with each form
    root = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):  # each round doubles the steps that a row has gone
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = root.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
