"""Quality classification by co-training (operator 1).

Two classifiers see different views of a page: its words, and its metadata (source, language, length and the shape of
its layout). Over some rounds each one labels, for the other, the unlabelled pages that it is surest of. At the end
their calibrated views are combined by a small logistic model fitted on labelled pages that neither was trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TEXT_SLOTS = 1 << 16
CATEGORY_SLOTS = 64
#: Page features that are shares and sizes; the slots of source and language follow.
SIZES = 23
#: Bound of the labelled rows that are trained on; every unlabelled row is in the pool.
LABELLED_ROWS = 5000
#: Text slots that the text classifier uses, those that tell most about the labels.
TEXT_FEATURES = 1024
#: Weight of all pseudo-labels together, at most, as a multiple of that of the labelled rows.
POOL_MASS = 0.5
#: A fit has settled where no entry of its gradient exceeds this; one that has not after so many passes raises.
SETTLED = 1e-3
PASSES = 200
#: Groups of tasks whose sums are added before the driver gets them.
SUMS = 64
#: Unlabelled rows of a block, and bins of the margins from -30 to 30.
BLOCK_ROWS = 2000
BINS = 4096
#: Words whose slot a worker remembers at most.
REMEMBERED = 100_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_known: dict[str, int] = {}


def text_slots(text: str) -> np.ndarray:
    """The slots of the lower-cased tokens of the whole text, and of how much its words repeat."""
    tokens = _TOKEN.findall(text.lower())
    kinds = set(tokens)
    if len(_known) > REMEMBERED:
        _known.clear()
    slots = []
    for token in kinds:
        slot = _known.get(token)
        if slot is None:
            slot = _known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % TEXT_SLOTS
        slots.append(slot)
    repeat = int(8 * len(kinds) / max(len(tokens), 1)) + 10 * min(6, len(tokens).bit_length() // 2)
    slots.append(zlib.crc32(b"\0repeat%d" % repeat) % TEXT_SLOTS)
    return np.unique(np.array(slots, np.int32))


def page_features(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata: layout shares and sizes, and one slot each for source and language."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(data, minlength=256)
    total = max(len(data), 1)
    lines, spaces = kinds[10] + 1, kinds[32] + 1
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    wide, marks = kinds[128:].sum(), kinds[33:127].sum() - upper - lower - digit
    shares = np.array([upper, digit, wide, marks, kinds[124], kinds[33], lines, spaces], float) / total
    sizes = np.r_[np.log1p([total, lines, spaces, total / lines, total / spaces, spaces / lines]), -1 if n_chars is None else np.log1p(max(n_chars, 0))]
    out = np.zeros(2 * len(shares) + len(sizes) + 2 * CATEGORY_SLOTS)
    out[: len(shares)] = shares
    out[len(shares) : 2 * len(shares)] = np.sqrt(shares)
    out[2 * len(shares) : 2 * len(shares) + len(sizes)] = sizes
    at = 2 * len(shares) + len(sizes)
    for i, value in enumerate((source, lang)):
        out[at + i * CATEGORY_SLOTS + zlib.crc32((value or "").encode("utf-8", "surrogatepass")) % CATEGORY_SLOTS] = 1
    return out


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 120) -> np.ndarray:
    """Logistic regression with a constant, by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    rate = 4 / (np.mean((x**2).sum(1)) + 4 * ridge)
    w = look = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look.astype(x.dtype), -30, 30)))
        slope = ((p - y) * weight / weight.sum()).astype(x.dtype) @ x + ridge * np.r_[look[:-1], 0]
        if np.abs(slope).max() < 1e-7:
            break
        new = look - rate * slope
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _scale(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling of one view's margins."""
    return _descend(z[:, None] / (z.std() + 1e-9), y, np.ones(len(y)), 1e-3) / np.r_[z.std() + 1e-9, 1]


def _sure(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    prior: float
    chosen: np.ndarray | None = None  # text slots
    text: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    page: np.ndarray | None = None
    blend: np.ndarray | None = None  # of (text, page) margins

    def score(self, text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Probability of good quality by text, by metadata, and by both."""
        if self.text is None:
            return self.prior, self.prior, self.prior
        text = text or ""
        slots = text_slots(text)
        at = np.searchsorted(self.chosen, slots)
        at = at[(at < len(self.chosen)) & (self.chosen[np.minimum(at, len(self.chosen) - 1)] == slots)]
        a = float(self.text[:-1][at].sum() + self.text[-1])
        b = float(((page_features(text, source, lang, n_chars) - self.centre) / self.spread) @ self.page[:-1] + self.page[-1])
        z = a * self.blend[0] + b * self.blend[1] + self.blend[2]
        return tuple(float(_sure(np.array(v))) for v in (a, b, z))


#: Unlabelled rows: text features of all rows in a row (each row's end with the constant), where rows start, page features.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Sums a vector that a function makes of blocks over the whole pool; None if the pool is empty.
PoolSum = Callable[[Callable[[Iterable[Block]], np.ndarray]], np.ndarray | None]


@dataclass
class Basis:
    """The features that the views use of a row."""

    chosen: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def words(self, slots: np.ndarray) -> np.ndarray:
        """Places of the chosen slots that a row has."""
        at = np.searchsorted(self.chosen, slots)
        return at[self.chosen[np.minimum(at, len(self.chosen) - 1)] == slots]

    def row(self, slots: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(self.words(slots), len(self.chosen)).astype(np.uint16), ((page - self.centre) / self.spread).astype(np.float32)


def block_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Block:
    ends = np.cumsum([len(words) for words, _ in rows])
    return np.concatenate([words for words, _ in rows]), np.r_[0, ends[:-1]], np.stack([page for _, page in rows])


def _margins(block: Block, texts: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Margins of a block's rows by each text and each page classifier."""
    words, starts, page = block
    w = np.stack(pages, 1)
    return np.add.reduceat(np.stack(texts, 1)[words], starts, axis=0), np.einsum("ij,jk->ik", page, w[:-1]) + w[-1]


@dataclass
class Teacher:
    """What a view labels for the other: 1 from ``high`` on, 0 up to ``low``."""

    w: np.ndarray
    low: float
    high: float


def _given(z: np.ndarray, teachers: list[Teacher]) -> np.ndarray:
    """Pseudo-labels of margins (rows, teachers): the first teacher that is sure counts; -1 without one."""
    out = np.full(len(z), -1)
    for k in reversed(range(len(teachers))):
        out[z[:, k] >= teachers[k].high] = 1
        out[z[:, k] <= teachers[k].low] = 0
    return out


def margin_counts(text: np.ndarray, page: np.ndarray) -> Callable[[Iterable[Block]], np.ndarray]:
    """Counts of the pool's rows in bins of both views' margins."""

    def count(blocks: Iterable[Block]) -> np.ndarray:
        out = np.zeros((2, BINS))
        for block in blocks:
            for view, z in enumerate(_margins(block, [text], [page])):
                at = ((np.clip(z[:, 0], -30, 30) + 30) / 60 * BINS).astype(int)
                out[view] += np.bincount(np.minimum(at, BINS - 1), minlength=BINS)
        return out.ravel()

    return count


def pool_gradient(text: np.ndarray, page: np.ndarray, teachers: list[list[Teacher]]) -> Callable[[Iterable[Block]], np.ndarray]:
    """Of each view, over the rows that the other view's teachers label for it: their number, log loss and its gradient."""

    def add(blocks: Iterable[Block]) -> np.ndarray:
        out = [np.zeros(2 + len(text)), np.zeros(2 + len(page))]
        for block in blocks:
            words, starts, shape = block
            z = _margins(block, [text, *(t.w for t in teachers[0])], [page, *(t.w for t in teachers[1])])
            for view in (0, 1):
                y = _given(z[1 - view][:, 1:], teachers[1 - view])
                own, margin = y >= 0, np.clip(z[view][:, 0], -30, 30)
                error = np.where(own, _sure(margin) - y, 0)
                out[view][0] += own.sum()
                out[view][1] += (np.logaddexp(0, margin) - y * margin)[own].sum()
                if view == 0:
                    out[view][2:] += np.bincount(words, np.repeat(error, np.diff(np.r_[starts, len(words)])), len(text))
                else:
                    out[view][2:-1] += error @ shape
                    out[view][-1] += error.sum()
        return np.concatenate(out)

    return add


class Search:
    """Minimises by L-BFGS steps; ``at`` is the point whose loss and gradient ``tell`` waits for, ``w`` the best so far."""

    def __init__(self, w: np.ndarray, rate: float):
        self.at, self.w, self.rate, self.pairs, self.loss = w, w, rate, [], np.inf

    def tell(self, loss: float, slope: np.ndarray) -> None:
        if loss > self.loss:
            self.step /= 4
            self.at = self.w + self.step * self.way
            return
        if self.loss < np.inf and (self.at - self.w) @ (slope - self.slope) > 1e-14:
            self.pairs.append((self.at - self.w, slope - self.slope))
        self.w, self.loss, self.slope, self.step = self.at, loss, slope, 1.0
        way, used = -slope, []
        for s, y in reversed(self.pairs):
            used.append(s @ way / (s @ y))
            way = way - used[-1] * y
        way = way * (self.pairs[-1][0] @ self.pairs[-1][1] / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else self.rate)
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            way = way + (a - y @ way / (s @ y)) * s
        self.way = way
        self.at = self.w + way


def _bounds(counts: np.ndarray, prior: float, rounds: int, sure: float) -> tuple[float, float]:
    """Margins (low, high) beyond which a view labels: its surest rows of each class, ties whole, never less sure than ``sure``."""
    n, least = counts.sum(), float(np.log(sure / (1 - sure)))
    want = [max(1, int(n * part / (2 * rounds))) for part in (1 - prior, prior)]
    low = int(np.searchsorted(np.cumsum(counts), want[0])) + 1
    high = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), want[1]))
    return min(low / BINS * 60 - 30, -least), max(high / BINS * 60 - 30, least)


def in_memory(rows: list[tuple[np.ndarray, np.ndarray]]) -> PoolSum:
    """A pool of given rows."""
    blocks = [block_of(rows[i : i + BLOCK_ROWS]) for i in range(0, len(rows), BLOCK_ROWS)]
    return lambda f: f(blocks) if blocks else None


def co_train(slots: list[np.ndarray], pages: np.ndarray, y: np.ndarray, rounds: int = 4, sure: float = 0.97, pool: Callable[[Basis], PoolSum] | None = None) -> Model:
    """Fit on rows with y in {0, 1} (labelled) or -1 (pool). A fifth of the labelled rows is kept for calibration.

    With ``pool`` the unlabelled rows are those of its sums, not the rows with y = -1. Pseudo-labels count half, and all
    together at most POOL_MASS times as much as the labelled rows, however large the pool is. A view keeps, and teaches by,
    the classifier of the round in which the kept rows were likeliest, so that a view that is taught wrongly falls back
    on what it knew; rounds end where neither view gains.
    """
    labelled = np.flatnonzero(y >= 0)
    prior = float(y[labelled].mean()) if len(labelled) else 0.5
    kept, fit = labelled[::5], np.setdiff1d(labelled, labelled[::5])
    if len(set(y[fit])) < 2 or len(set(y[kept])) < 2:
        return Model(prior)
    seen = np.zeros((2, TEXT_SLOTS))
    for i in fit:
        seen[y[i], slots[i]] += 1
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()])[:, None]
    each, alike = (seen + 0.5) / (n + 1), (seen.sum(0) + 0.5) / (n.sum() + 1)
    tell = sum(n[k] * (each[k] * np.log(each[k] / alike) + (1 - each[k]) * np.log((1 - each[k]) / (1 - alike))) for k in (0, 1))
    tell[seen.sum(0) < 3] = 0
    chosen = np.sort(np.argsort(-tell, kind="stable")[:TEXT_FEATURES]).astype(np.int32)
    basis = Basis(chosen, pages[fit].mean(0), pages[fit].std(0) + 0.05)
    words = np.zeros((len(y), len(chosen)), np.float32)
    for i in labelled:
        words[i, basis.words(slots[i])] = 1
    shape = ((pages - basis.centre) / basis.spread).astype(np.float32)
    views, target = (words, shape), y[fit].astype(float)
    total = pool(basis) if pool else in_memory([basis.row(slots[i], pages[i]) for i in np.flatnonzero(y < 0)])
    start = [np.zeros(view.shape[1] + 1) for view in views]
    raw = _fit([v[fit] for v in views], target, start, None, [])  # of the labelled rows alone
    teachers: list[list[Teacher]] = [[], []]
    scaled, least = [None, None], [np.inf, np.inf]  # of each view the best so far, and its log loss on the kept rows
    for k in range(rounds + 1):
        before = list(least)
        for i, (view, w) in enumerate(zip(views, raw, strict=True)):
            a, b = _scale(_logit(view[kept], w), y[kept])
            new = np.r_[w[:-1] * max(a, 1e-3), w[-1] * max(a, 1e-3) + b]
            z = _logit(view[kept], new)
            loss = float((np.logaddexp(0, z) - y[kept] * z).mean())
            if loss < least[i]:
                scaled[i], least[i] = new, loss
        if k == rounds or least == before:
            break
        counts = total(margin_counts(*scaled))
        if counts is None:
            break
        for view in (0, 1):
            teachers[view].append(Teacher(scaled[view], *_bounds(counts.reshape(2, BINS)[view], prior, rounds, sure)))
        raw = _fit([v[fit] for v in views], target, raw, total, teachers)
    both = np.stack([_logit(v[kept], w) for v, w in zip(views, scaled, strict=True)], 1)
    blend = _descend(both / (both.std(0) + 1e-9), y[kept], np.ones(len(kept)), 1e-3, 400) / np.r_[both.std(0) + 1e-9, 1]
    return Model(prior, chosen, scaled[0], basis.centre, basis.spread, scaled[1], blend)


def _fit(views: list[np.ndarray], y: np.ndarray, start: list[np.ndarray], total: PoolSum | None, teachers: list[list[Teacher]], ridge: float = 1e-3) -> list[np.ndarray]:
    """Both logistic regressions over the labelled rows and all pool rows with pseudo-labels, from ``start`` until both have settled."""
    searches = [Search(w, 4 / (np.mean((x**2).sum(1)) + 1 + 4 * ridge)) for x, w in zip(views, start, strict=True)]
    none = np.zeros(sum(2 + len(w) for w in start))
    for _ in range(PASSES):
        sums = total(pool_gradient(*(s.at for s in searches), teachers)) if total else none
        for s, x, own in zip(searches, views, np.split(sums, [2 + len(start[0])]), strict=True):
            z = np.clip(_logit(x, s.at), -30, 30)
            error = _sure(z) - y
            half = min(0.5, POOL_MASS * len(y) / max(own[0], 1))
            mass, flat = len(y) + half * own[0], np.r_[s.at[:-1], 0]
            loss = ((np.logaddexp(0, z) - y * z).sum() + half * own[1]) / mass + ridge / 2 * flat @ flat
            s.tell(loss, (np.r_[error @ x, error.sum()] + half * own[2:]) / mass + ridge * flat)
        if all(np.abs(s.slope).max() <= SETTLED for s in searches):
            return [s.w for s in searches]
    raise RuntimeError(f"fits of the views have not settled after {PASSES} passes")


def stored_pool(docs: DataFrame, told: DataFrame, basis: Basis) -> PoolSum:
    """All rows of ``docs`` without a label, rows without doc_id too, as packed features in the shared folder."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
            words, pages = [], []
            for row in batch.to_pylist():
                text = row["text"] or ""
                page = page_features(text, row["source"], row["lang"], row["n_chars"])
                own = basis.row(text_slots(text), page)
                words.append(own[0].tobytes())
                pages.append(own[1][:SIZES].tobytes() + np.flatnonzero(page[SIZES:]).astype(np.uint8).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(words, pa.binary()), pa.array(pages, pa.binary())], ["doc_id", "words", "pages"])

    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    with_id, without = (rows.where(f"doc_id IS {kind}").mapInArrow(features, "doc_id long, words binary, pages binary") for kind in ("NOT NULL", "NULL"))
    parts = with_id.join(told.select("doc_id"), "doc_id", "left_anti").unionByName(without)
    stored = materialize(parts.select("words", "pages"), "quality_pool")

    def total(f: Callable[[Iterable[Block]], np.ndarray]) -> np.ndarray | None:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for batch in (whole.slice(at, BLOCK_ROWS) for whole in batches for at in range(0, len(whole), BLOCK_ROWS)):
                words = batch.column(0).to_pylist()
                ends = np.cumsum([len(x) // 2 for x in words])
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(words), -1)
                page = np.tile((-basis.centre / basis.spread).astype(np.float32), (len(words), 1))
                page[:, :SIZES] = packed[:, : 4 * SIZES].copy().view(np.float32)
                for at in packed[:, 4 * SIZES :].T.astype(int) + SIZES:
                    page[np.arange(len(words)), at] += (1 / basis.spread[at]).astype(np.float32)
                yield np.frombuffer(b"".join(words), np.uint16), np.r_[0, ends[:-1]], page

        def own_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = read(batches)
            first = next(own, None)
            if first is not None:
                sums, group = f(chain([first], own)), TaskContext.get().partitionId() % SUMS
                yield pa.record_batch([pa.array([group], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["group", "total"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for value in (x for batch in batches for x in batch.column(1).to_pylist()):
                sums = np.frombuffer(value) if sums is None else sums + np.frombuffer(value)
            if sums is not None:
                yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["total"])

        grouped = stored.mapInArrow(own_sum, "group int, total binary").repartition("group").mapInArrow(add_up, "total binary")
        sums = [np.frombuffer(r[0]) for r in grouped.collect()]  # SUMS at most
        return np.sum(sums, 0) if sums else None

    return total


def train(docs: DataFrame, labels: DataFrame, label: Column, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from ``docs(doc_id, text, lang, source, n_chars)`` and ``labels(doc_id, ...)``.

    ``label`` is a boolean column over ``labels``; null means unlabelled. Of several labels of one document the lowest
    counts. The labelled sample is bounded by ``labelled_rows``, chosen by a hash of ``doc_id``; every unlabelled row is
    scored in each round and fitted where the other view is sure of it.

    Null texts count as empty, null sources and languages as kinds of their own. Of several rows of one labelled
    ``doc_id`` the least counts; unlabelled rows count as often as they stand, those without ``doc_id`` too. Without
    labels of both kinds, or with an empty table, the model holds the labels' mean (0.5 without labels).
    """
    told = labels.where("doc_id IS NOT NULL").select("doc_id", label.cast("int").alias("y")).where("y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = told.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled_rows)
    own = F.min(F.struct(F.col("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars")))  # one of an id's rows
    rows = docs.join(picked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(own.alias("r")).select("doc_id", "r.*").join(picked, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, pages = [], []
            for row in batch.to_pylist():
                slots.append(text_slots(row["text"] or "").tolist())
                pages.append(page_features(row["text"] or "", row["source"], row["lang"], row["n_chars"]).tolist())
            columns = [batch.column(0), batch.column(5), pa.array(slots, pa.list_(pa.int32())), pa.array(pages, pa.list_(pa.float64()))]
            yield pa.record_batch(columns, ["doc_id", "y", "slots", "pages"])

    sample = rows.select("doc_id", "text", "source", "lang", "n_chars", "y").mapInArrow(features, "doc_id long, y int, slots array<int>, pages array<double>")
    sample = sample.toArrow().to_pandas().sort_values("doc_id", kind="stable")  # labelled_rows at most
    if not len(sample):
        return Model(0.5)
    slots, pages = [np.asarray(x, np.int32) for x in sample["slots"]], np.stack(sample["pages"].to_numpy())
    return co_train(slots, pages, sample["y"].to_numpy(), pool=lambda basis: stored_pool(docs, told, basis))


def good(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The label: good quality and, where it is known, not toxic."""
    return (F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0)


def score(docs: DataFrame, model: Model, out: str = "judged") -> DataFrame:
    """``docs`` with a struct ``out(p_text, p_page, p_quality)``, read from text, source, lang and n_chars.

    Null text counts as empty, null source and lang as categories of their own. Without labels of both kinds every row
    gets the labels' mean (0.5 without labels). Repeated rows get equal answers, an empty table gives an empty one; other
    columns stay as they are, one with the name ``out`` is replaced.
    """

    @F.pandas_udf("p_text double, p_page double, p_quality double")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sources, langs, sizes in parts:
            rows = zip(texts, sources, langs, (None if pd.isna(n) else int(n) for n in sizes), strict=True)
            yield pd.DataFrame([model.score(*r) for r in rows], columns=["p_text", "p_page", "p_quality"])

    return docs.withColumn(out, judge("text", "source", "lang", F.col("n_chars").cast("long")))
