"""Packing into optimal length buckets and token-budget batches (operator 3)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

def words(column: str = "text"):
    """Length of a text in white-space separated words; null counts as empty."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise the padding sum(count * (end - length)).

    Dynamic programming over the sorted distinct lengths; the padding cost obeys the quadrangle inequality, so each
    layer is solved by divide and conquer in O(m log m).
    """
    m = len(lengths)
    if not m:
        return []
    size, most = lengths.astype(np.int64), np.iinfo(np.int64).max // 4
    rows, tokens = np.r_[0, np.cumsum(counts, dtype=np.int64)], np.r_[0, np.cumsum(counts * size)]

    def padding(lo, hi: int):  # of lengths[lo:hi] in one bucket
        return (rows[hi] - rows[lo]) * size[hi - 1] - (tokens[hi] - tokens[lo])

    ends_at = np.arange(1, m + 1)
    cost = np.r_[0, rows[ends_at] * size - tokens[ends_at]]
    choices: list[np.ndarray] = []
    for _ in range(min(buckets, m) - 1):
        new, cut = np.full(m + 1, most), np.zeros(m + 1, np.int64)
        new[0] = 0
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            at = np.arange(first, min(last, mid - 1) + 1)
            value = cost[at] + padding(at, mid)
            k = int(np.argmin(value))
            new[mid], cut[mid] = value[k], at[k]
            todo += [(lo, mid - 1, first, int(at[k])), (mid + 1, hi, int(at[k]), last)]
        choices.append(cut)
        cost = new
    ends, j = [], m
    for cut in reversed(choices):
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    if j:
        ends.append(int(lengths[j - 1]))
    return sorted(set(ends))


def pack(docs: DataFrame, length, buckets: int = 8, token_budget: int = 32768, rows_per_salt: int = 4096) -> DataFrame:
    """``docs(doc_id, ...)`` -> ``(doc_id, n_tokens, bucket, bucket_len, batch_id, row_in_batch, padding)``, a row for each row.

    ``length`` is a column of non-negative token counts. A batch holds ``max(1, token_budget // bucket_len)`` rows of one
    bucket, each padded to ``bucket_len``; only the last batch of a bucket is short. Batches are numbered through all
    buckets. Rows with null or empty texts have length 0 and cost padding only; one longer than the budget is a batch
    of its own. Equal lengths, repeated rows and null ids are all kept. Other columns are not read; an empty table gives
    an empty one.

    Within a bucket rows are in the order of the MD5 of their ``doc_id`` (null as empty), then of ``doc_id`` and length;
    where one id has very many rows, those of a stretch of that order are taken in any order.

    The histogram of all lengths is solved on the driver: m different lengths need m * (m + 1) / 2 tokens at least, so
    there are sqrt(2 * tokens) of them at most. Rows are numbered without a global window: stretches of the hash (salts)
    are numbered alone, and their counts give each its offset; a stretch with too many rows of one id is dealt again.
    """
    spark = docs.sparkSession
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", length.alias("n_tokens")).withColumns({"hashed": hashed, "line": F.monotonically_increasing_id()})
    sized = materialize(sized, "lengths")
    histogram = sized.groupBy("n_tokens").count().toArrow()
    found, rows = histogram.column("n_tokens").to_numpy(), histogram.column("count").to_numpy()
    ordered = np.argsort(found)
    ends = best_boundaries(found[ordered], rows[ordered], buckets) or [0]
    salts = max(1, math.ceil(int(rows.sum()) / rows_per_salt))
    end_of = spark.createDataFrame([(i, e, max(1, token_budget // max(e, 1))) for i, e in enumerate(ends)], "bucket int, bucket_len long, per_batch long")
    bucket = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("salt", F.floor(F.col("hashed") * F.lit(salts) / F.lit(float(1 << 32))))
    full = placed.groupBy("bucket", "salt").count().where(F.col("count") > 4 * rows_per_salt).selectExpr("bucket", "salt", f"ceil(count / {float(rows_per_salt)}) AS deals")
    placed = placed.join(full, ["bucket", "salt"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("line"), F.col("deals")), F.lit(0).cast("long"))).drop("deals", "line", "hashed")
    by = ["bucket", "salt", "deal"]
    counts = placed.groupBy(*by).count()
    if salts == 1:
        counts = counts.selectExpr(*by, "count", "sum(count) OVER (PARTITION BY bucket ORDER BY salt, deal) - count AS before")
    else:  # running counts in two steps, so that no task sees the counts of all salts of a bucket
        counts = counts.withColumn("run", F.floor(F.col("salt") / max(1, math.isqrt(salts))))
        runs = counts.groupBy("bucket", "run").agg(F.sum("count").alias("in_run"))
        runs = runs.selectExpr("bucket", "run", "sum(in_run) OVER (PARTITION BY bucket ORDER BY run) - in_run AS run_before")
        counts = counts.selectExpr(*by, "run", "count", "sum(count) OVER (PARTITION BY bucket, run ORDER BY salt, deal) - count AS in_run_before")
        counts = counts.join(runs, ["bucket", "run"]).selectExpr(*by, "count", "run_before + in_run_before AS before")
    counts = materialize(counts, "salts")
    batches = (
        counts.groupBy("bucket").agg(F.sum("count").alias("in_bucket")).join(F.broadcast(end_of), "bucket")
        .selectExpr("bucket", "bucket_len", "per_batch", "sum(ceil(in_bucket / per_batch)) OVER (ORDER BY bucket) - ceil(in_bucket / per_batch) AS first_batch")
    )  # one row for each bucket
    numbered = placed.withColumn("order", order).selectExpr("*", "row_number() OVER (PARTITION BY bucket, salt, deal ORDER BY order, doc_id, n_tokens) - 1 AS k")
    at = numbered.join(counts.select(*by, "before"), by).join(F.broadcast(batches), "bucket")
    at = at.withColumn("rank", F.col("before") + F.col("k"))
    return at.selectExpr(
        "doc_id", "n_tokens", "bucket", "bucket_len", "CAST(first_batch + floor(rank / per_batch) AS LONG) AS batch_id",
        "CAST(rank % per_batch AS LONG) AS row_in_batch", "bucket_len - n_tokens AS padding",
    )
