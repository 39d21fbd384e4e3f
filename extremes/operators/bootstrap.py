"""Resampled fits with intervals, and simulated critical values. All draws come from md5, so that they can be repeated anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import label, quantile_levels
from ..functions import gev
from ..shared import stage
from . import fit as fits
from .ranks import rank_and_ecdf

#: Bytes of draws that every task is sent, and that a task keeps of those it makes itself.
SHARED_BYTES = 64 << 20


def draw(seed: int, n: Column, sample: Column, k: Column) -> Column:
    """A number from 0 to n - 1."""
    text = F.concat_ws("-", F.lit(str(seed)), n.cast("string"), sample.cast("string"), k.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n.cast("long"))


def draws_of(seed: int, n: int, n_sample: int, first: int = 0) -> np.ndarray:
    """The same draws as ``draw``, as an array samples x n, from the sample ``first`` on."""
    one = lambda s, k: int(hashlib.md5(f"{seed}-{n}-{s}-{k}".encode()).hexdigest()[:8], 16) % n
    return np.array([[one(s, k) for k in range(n)] for s in range(first, first + n_sample)], np.int64).reshape(n_sample, n)


def shared_draws(spark: SparkSession, lengths: dict[int, int], n_sample: int, seed: int, most_bytes: int = SHARED_BYTES) -> dict[int, np.ndarray]:
    """The draws of record lengths, each hashed once, by tasks of their own: of the commonest of ``lengths`` (n: series), as many as ``most_bytes`` hold."""
    chosen, free = [], most_bytes
    for n in sorted(lengths, key=lambda n: (-lengths[n], n)):
        if 4 * n * n_sample <= free:
            chosen.append(n)
            free -= 4 * n * n_sample
    if not chosen:
        return {}
    step = max(1, 20_000 // max(chosen))  # samples of a piece

    def draw_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(drawn=[draws_of(seed, n, hi - lo, lo).astype(np.int32).tobytes() for n, lo, hi in zip(pdf["n"], pdf["lo"], pdf["hi"], strict=True)])

    pieces = spark.createDataFrame([(n, lo, min(lo + step, n_sample)) for n in chosen for lo in range(0, n_sample, step)], "n int, lo int, hi int")
    rows = pieces.repartition(spark.sparkContext.defaultParallelism).mapInPandas(draw_pieces, "n int, lo int, hi int, drawn binary").collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["lo"]):
        out.setdefault(r["n"], []).append(np.frombuffer(r["drawn"], np.int32).reshape(-1, r["n"]))
    return {n: np.concatenate(parts) for n, parts in out.items()}


class Draws:
    """Draws by record length: those that are shared, and of others those last used, within ``most_bytes``."""

    def __init__(self, shared, seed: int, n_sample: int, most_bytes: int = SHARED_BYTES):
        self.shared, self.seed, self.n_sample, self.most_bytes = shared, seed, n_sample, most_bytes
        self.own: dict[int, np.ndarray] = {}

    def __call__(self, n: int) -> np.ndarray:
        found = self.shared.value.get(n)
        if found is None:
            found = self.own.pop(n, None)
            if found is None:
                found = draws_of(self.seed, n, self.n_sample).astype(np.int32)
            self.own[n] = found  # the last one used stands last
            while len(self.own) > 1 and sum(x.nbytes for x in self.own.values()) > self.most_bytes:
                del self.own[next(iter(self.own))]
        return found


def fit_samples_sql(ams: DataFrame, keys: list[str], n_sample: int, seed: int = 1, shape: float | None = None) -> DataFrame:
    """``(keys, duration, sample, location, scale, shape)`` by joins: series are numbered by block, samples draw numbers.

    Sample -1 is the series itself. For small inputs and tests; ``fit_with_intervals`` does not multiply rows.
    """
    by = [*keys, "duration"]
    valid = ams.where("annual_max IS NOT NULL").selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY block) - 1 AS idx", f"count(*) OVER (PARTITION BY {', '.join(by)}) AS n")
    lengths = valid.select("n").distinct()
    table = lengths.selectExpr("n", f"explode(sequence(0, {n_sample - 1})) AS sample").selectExpr("n", "sample", "explode(sequence(0, cast(n AS INT) - 1)) AS k")
    table = table.select("n", "sample", draw(seed, F.col("n"), F.col("sample"), F.col("k")).alias("idx"))
    drawn = valid.join(table, ["n", "idx"]).select(*by, "sample", "annual_max")
    own = valid.select(*by, F.lit(-1).alias("sample"), "annual_max")
    ranked = rank_and_ecdf(drawn.unionByName(own), [*by, "sample"])
    return fits.fit_gev(ranked, [*by, "sample"], shape=shape).drop("n_obs")


def sample_moments(x: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """b0, b1, b2 of every resample of ``x`` (rows of ``drawn``), without sorting each: counts of the distinct sorted values."""
    values, place = np.unique(x, return_inverse=True)
    n = len(x)
    counts = np.zeros((len(drawn), len(values)))
    np.add.at(counts, (np.arange(len(drawn))[:, None], place[drawn]), 1)
    ecdf = (np.cumsum(counts, 1) - (counts - 1) / 2) / n
    return np.stack([(counts * ecdf**r) @ values / n for r in range(3)], 1)


def _gamma(x: np.ndarray) -> np.ndarray:
    c = gev._LANCZOS
    y = x - 1
    t = y + 7.5
    return np.sqrt(2 * np.pi) * t ** (y + 0.5) * np.exp(-t) * (c[0] + sum(k / (y + i) for i, k in enumerate(c[1:], 1)))


def params_of(b: np.ndarray, shape: float | None) -> np.ndarray:
    """Location, scale, shape of rows of moments."""
    l2 = 2 * b[:, 1] - b[:, 0]
    with np.errstate(all="ignore"):
        if shape is None:
            c = l2 / (3 * b[:, 2] - b[:, 0]) - 0.63093
            k = 7.859 * c + 2.9554 * c * c
        else:
            k = np.full(len(b), float(shape))
        g = _gamma(1 + k)
        scale = np.where(k == 0, l2 / 0.6931, l2 * k / (g * (1 - 2.0**-k)))
        loc = np.where(k == 0, b[:, 0] - gev.EULER * scale, b[:, 0] - scale * (1 - g) / k)
    return np.stack([loc, scale, k], 1)


def fit_with_intervals(ams: DataFrame, keys: list[str], n_sample: int = 500, widths=(0.95,), seed: int = 1, shape: float | None = None) -> DataFrame:
    """``(keys, duration, ci, ev_param, gev, gev_scaled, slope, intercept, rsquared, spearman)``.

    ``ci`` is 'estimate' or a quantile level over the resamples. Blocks are drawn, the same for all series of one
    length; a length's draws are made once and sent to all tasks, within SHARED_BYTES. One task step for each location: its samples are
    never rows. Scaling values repeat on each duration. ``ams`` is staged, and its record lengths come to the driver.
    """
    levels = quantile_levels(widths)
    labels = ["estimate", *map(label, levels)]
    kinds = dict(ams.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", duration {kinds['duration']}, ci string, ev_param string, gev double, gev_scaled double, slope double, intercept double, rsquared double, spearman double"
    ams = stage(ams.select(*keys, "duration", "block", "annual_max"), "maxima")
    sizes = ams.where("annual_max IS NOT NULL").groupBy(*keys, "duration").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    shared = shared_draws(ams.sparkSession, {r["n"]: r["c"] for r in sizes.collect()}, n_sample, seed)
    drawn = Draws(ams.sparkSession.sparkContext.broadcast(shared), seed, n_sample)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        params, durations = [], []
        for d, own in pdf.dropna(subset=["annual_max"]).sort_values("block").groupby("duration"):
            x = own["annual_max"].to_numpy(float)
            b = np.concatenate([sample_moments(x, part) for part in np.array_split(drawn(len(x)), max(1, len(x) * n_sample // 1_000_000))])
            params.append(params_of(np.concatenate([sample_moments(x, np.arange(len(x))[None]), b]), shape))
            durations.append(d)
        if not params:
            return pd.DataFrame(columns=[c.split()[0].strip("`") for c in schema.split(", ")])
        p = np.stack(params)  # durations x samples x parameters
        with np.errstate(all="ignore"):
            y = np.where(p > 0, np.log10(p), np.nan)
        lx = np.log10(np.array(durations, float))[:, None, None]
        lines = _lines(lx, y)
        fitted = 10 ** (lines["intercept"] + lines["slope"] * lx)
        fitted[..., 2] = p[..., 2]
        rows = []
        def pick(a: np.ndarray) -> list[float]:
            valid = a[1:][np.isfinite(a[1:])]
            return [a[0], *(np.quantile(valid, levels) if len(valid) else [np.nan] * len(levels))]

        head = [pdf[k].iloc[0] for k in keys]
        for j, name in enumerate(fits.PARAMS):
            line = {k: pick(v[:, j]) for k, v in lines.items()}
            for i, d in enumerate(durations):
                own = pick(p[i, :, j]), pick(fitted[i, :, j]), *(line[k] for k in ("slope", "intercept", "rsquared", "spearman"))
                rows += [[*head, d, ci, name, *(x[c] for x in own)] for c, ci in enumerate(labels)]
        return pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    out = ams.groupBy(*keys).applyInPandas(one, schema)
    return out.select(*keys, "duration", "ci", "ev_param", *[gev.no_nan(F.col(c)).alias(c) for c in ("gev", "gev_scaled", "slope", "intercept", "rsquared", "spearman")])


def _lines(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Least squares along the first axis; missing where a value is missing or does not vary."""
    mx, my = x.mean(0), y.mean(0)
    sxx, sxy, syy = ((x - mx) ** 2).sum(0), ((x - mx) * (y - my)).sum(0), ((y - my) ** 2).sum(0)
    with np.errstate(all="ignore"):
        slope = sxy / sxx
        rank = lambda v: ((v[None] < v[:, None]).sum(1) + (v[None] == v[:, None]).sum(1) / 2).astype(float)  # noqa: E731  ties averaged
        order, rank_x = rank(y), rank(x)
        rx, ry = rank_x - rank_x.mean(0), order - order.mean(0)
        rho = (rx * ry).sum(0) / np.sqrt((rx**2).sum(0) * (ry**2).sum(0))
        r2 = sxy**2 / (sxx * syy)
    missing = np.isnan(y).any(0)
    return {"slope": slope, "intercept": my - slope * mx, "rsquared": np.where(syy > 0, r2, np.nan), "spearman": np.where(missing, np.nan, rho)}


def critical_d(spark: SparkSession, lengths: DataFrame, shape: float, n_sample: int = 10_000, seed: int = 1, levels=(0.05, 0.1)) -> DataFrame:
    """``lengths(n)`` -> ``(n, significance_level, Dcrit)``: simulated series are ranked and refitted, D's quantiles are the limits."""
    u = lambda: (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(f"d{seed}"), F.col("n").cast("string"), F.col("sample").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = lengths.select(F.col("n").cast("int").alias("n")).distinct().selectExpr("n", f"explode(sequence(0, {n_sample - 1})) AS sample")
    rows = rows.repartition("n", "sample").selectExpr("n", "sample", "explode(sequence(1, n)) AS k")  # the windows' partitioning, and parallel from here on
    y = (1 - F.pow(-F.ln(u()), F.lit(shape))) / shape if shape else -F.ln(-F.ln(u()))
    series = rows.withColumn("annual_max", y)
    by = ["n", "sample"]
    ranked = rank_and_ecdf(series, by)
    points = fits.gof_points(ranked, fits.fit_gev(ranked, by, shape=shape), by)
    d = points.groupBy(*by).agg(F.max(F.abs(F.col("ecdf") - F.col("cdf"))).alias("d"))
    at = d.groupBy("n").agg(*[F.percentile("d", F.lit(1 - a)).alias(f"d{i}") for i, a in enumerate(levels)])
    pairs = ", ".join(f"CAST({a} AS DOUBLE), d{i}" for i, a in enumerate(levels))
    return at.selectExpr("n", f"stack({len(levels)}, {pairs}) AS (significance_level, Dcrit)")
