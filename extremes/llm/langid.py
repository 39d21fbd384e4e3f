"""Language identification with error-correcting output codes (operator 5).

Every language has a codeword of bits. One linear classifier for each bit, on hashed character 2- and 3-grams, says how
likely the bit is set; the language whose codeword loses least, bits weighted by how well they are told, is chosen.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SLOTS = 1 << 13
#: Labelled rows, about, on which bit margins are calibrated, a fifth of all at most; the n-gram counts cover all others.
CALIBRATION_ROWS = 2000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """How often each slot's 2- and 3-grams occur in the lower-cased whole text."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    counts = np.bincount((two * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=SLOTS)
    three = two[:-1] * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x27D4EB2F)
    return counts + np.bincount((three * np.uint32(0x165667B1)) >> np.uint32(19), minlength=SLOTS)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all distinct splits for up to six classes, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits, best, most = np.random.default_rng(n), int(np.ceil(15 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[:, np.abs(code.sum(0)) == n] = rng.permutation(np.resize([1.0, -1.0], n))[:, None]
        apart = code @ code.T
        np.fill_diagonal(apart, -bits)
        if (distance := (bits - apart.max()) / 2) > most:
            best, most = code, distance
    return best


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L occurs; other numbers than decimal digits are no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # of each bit
    margin: float = 0.1  # losses closer than this are ambiguous

    def margins(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        used = np.flatnonzero(counts)
        n = counts.sum()
        return counts[used] @ self.weights[used] / n * np.sqrt(min(n, 400))

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        told = self.margins(text) * self.slope + self.offset
        loss = np.logaddexp(0, -self.code * told) @ self.trust
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < self.margin)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in totals:
                totals[lang] = np.zeros(SLOTS, np.int64)
            totals[lang] += gram_counts(text.as_py())
            rows[lang] = rows.get(lang, 0) + 1
    salt = TaskContext.get().partitionId() // 256
    for lang, counts in totals.items():
        yield pa.record_batch([[lang], pa.array([salt], pa.int32()), [counts.tobytes()], [rows[lang]]], ["lang", "salt", "counts", "n"])


def _sum(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))
    return pa.table({"lang": [group.column("lang")[0].as_py()], "counts": [total.tobytes()], "n": [sum(group.column("n").to_pylist())]})


def _fit_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) over margins z, with smoothed targets and a small ridge."""
    up = y.sum()
    target = np.where(y, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, label: Column, text: Column, key: Column, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learn from the rows of ``docs`` with a label and a text with letters; ``key`` picks the calibration rows.

    Calibration rows are left out of the n-gram counts, on which the bits' classifiers rest. Null labels and texts are
    left out; repeated rows count as often as they stand; without rows, or of one language only, the model knows none or
    that one. The driver holds the counts of one language at a time, and two vectors for each bit.
    """
    told_rows = docs.where(label.isNotNull()).count()
    part = int((1 << 30) * min(0.2, calibration_rows / max(told_rows, 1)))
    rows = docs.select(label.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 30)).alias("pick"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sums = (
        rows.where(F.col("pick") >= part).select("lang", "text").mapInArrow(_count, "lang string, salt int, counts binary, n long")
        .groupBy("lang", "salt").applyInArrow(_sum, "lang string, counts binary, n long")
        .groupBy("lang").applyInArrow(_sum, "lang string, counts binary, n long")
    )
    sums = materialize(sums, "languages")
    languages = sorted(r["lang"] for r in sums.select("lang").collect())
    code, place = codewords(len(languages)), {x: i for i, x in enumerate(languages)}
    bits = code.shape[1]
    model = Model(languages, code, np.zeros((SLOTS, bits)), np.ones(bits), np.zeros(bits), np.ones(bits) / bits)
    if len(languages) < 2:
        return model
    up, down = np.zeros((SLOTS, bits)), np.zeros((SLOTS, bits))
    for r in sums.toLocalIterator():
        share = np.frombuffer(r["counts"], np.int64) + 0.5
        is_up = code[place[r["lang"]]] > 0
        up[:, is_up] += (share / share.sum())[:, None]
        down[:, ~is_up] += (share / share.sum())[:, None]
    model.weights = np.log(up / (code > 0).sum(0)) - np.log(down / (code < 0).sum(0))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = [model.margins(t.as_py()).tolist() for t in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(z, pa.list_(pa.float64()))], ["lang", "z"])

    kept = rows.where((F.col("pick") < part) & F.col("lang").isin(languages)).select("lang", "text")
    sample = kept.mapInArrow(told, "lang string, z array<double>").limit(2 * calibration_rows).toPandas()
    if len(sample) > 1:
        z, y = np.stack(sample["z"].to_numpy()), code[[place[x] for x in sample["lang"]]] > 0
        for b in range(bits):
            model.slope[b], model.offset[b] = _fit_logistic(z[:, b], y[:, b])
            model.trust[b] = max(0.05, 2 * ((z[:, b] * model.slope[b] + model.offset[b] > 0) == y[:, b]).mean() - 1)
        model.trust /= model.trust.sum() / max(1.0, np.log2(len(languages)))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_id") -> DataFrame:
    """``docs`` with a struct ``out(lang_pred, score, ambiguous)``.

    Only ``text`` is read. Null texts and texts without letters get ``und``, score 0, ambiguous; so does every text
    if the model knows no language. Repeated rows get equal answers, an empty table gives an empty one; other columns stay
    as they are, one with the name ``out`` is replaced.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([model.decide(x) for x in part], columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(out, decide(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    return train(docs.where(~held_out()), F.col("lang"), F.col("text"), F.col("doc_id"))
