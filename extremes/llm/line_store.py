"""Reversible line deduplication with sharded cuckoo filters over exact reference tables (operator 13).

A ``LineStore`` holds three tables. *References* have a row for each document and distinct long line (as a 128-bit key).
*Counts* have a row for each key: its references, and the smallest and largest document that holds it. *Filters* have a
cuckoo filter for each shard of the keys, with one fingerprint for each key of the counts. Inserting documents asks the filters
first: keys that they have not seen are new for certain and enter the counts as they are; only keys that they may have seen
are joined with the counts, which also tells false alarms. Deleting documents takes their references back, lets counts follow
and removes the fingerprints of keys that nobody holds any more, so that a store after insertion and deletion equals the
one before. A line goes from every document that holds it but the smallest.

Shards double as the keys grow, so a filter has a bounded size and a task holds one shard's keys. A key that many documents hold is
one row of the batch's partial counts before it is dealt to its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize

SPACE = " \t\n\x0b\x0c\r"
#: Keys that a shard is made for; its filter has twice as many slots.
SHARD_KEYS = 1 << 16
SLOTS = 4
KICKS = 500
#: References that a task gathers before it puts them out.
HELD = 50_000


class CuckooFilter:
    """A set of 64-bit hashes as 16-bit fingerprints, two buckets of four slots for each; can be deleted from.

    It never forgets what was added; ``contains`` is wrongly true for one hash in some eight thousand. Fingerprints that find no slot
    go into a short exact list, so adding never fails.
    """

    def __init__(self, keys: int, table: np.ndarray | None = None, stash: np.ndarray | None = None):
        buckets = 1 << max(1, (2 * max(keys, 1) // SLOTS - 1).bit_length())
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        #: (bucket, fingerprint), the lower of the two buckets
        self.stash = [] if stash is None else [tuple(x) for x in stash.tolist()]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = ((hashes >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        return print_, one, self._other(one, print_)

    def _other(self, bucket, print_):
        """The second bucket of a fingerprint, from either of them."""
        return bucket ^ ((np.asarray(print_).astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(hashes)
        found = (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)
        if self.stash:
            held = set(self.stash)
            found |= np.fromiter(((int(b), int(p)) in held for b, p in zip(np.minimum(one, two), print_)), bool, len(print_))
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Add each hash once more; hashes that are there already get a further fingerprint."""
        print_, one, two = self._places(hashes)
        rest = np.arange(len(hashes))
        for bucket in (one, two):
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            # the k-th newcomer of a bucket takes its k-th free slot
            at = bucket[rest]
            begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, int)
            k = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
            free = self.table[at] == 0
            fits = k < free.sum(axis=1)
            slot = np.argmax(free.cumsum(axis=1) == (k + 1)[:, None], axis=1)
            self.table[at[fits], slot[fits]] = print_[rest[fits]]
            rest = rest[~fits]
        for i in rest:
            self._push_in(int(one[i]), int(print_[i]))

    def _push_in(self, bucket: int, print_: int) -> None:
        """Move fingerprints to their other buckets until one finds a free slot."""
        for k in range(KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return
            slot = (k * 7 + print_) % SLOTS
            self.table[bucket, slot], print_ = print_, int(self.table[bucket, slot])
            bucket = int(self._other(bucket, print_))
        self.stash.append((min(bucket, int(self._other(bucket, print_))), print_))

    def remove(self, hashes: np.ndarray) -> None:
        """Take one fingerprint of each hash out; all of them must have been added."""
        for print_, one, two in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in (one, two):
                slots = np.flatnonzero(self.table[bucket] == print_)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            else:
                self.stash.remove((min(one, two), print_))

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int.from_bytes(data[:8], "little")
        end = 8 + buckets * SLOTS * 2
        return cls(0, np.frombuffer(data[8:end], np.uint16).reshape(buckets, SLOTS).copy(), np.frombuffer(data[end:], np.int64).reshape(-1, 2))


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line: its stripped text, A-Z as a-z, as 128 bits; none if that has fewer than ``least`` code points."""
    bare = line.strip(SPACE)
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(bare) >= least else None


def references(docs: DataFrame, least: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, key)``, a row for each row of ``docs`` and distinct key in it; rows without id or text have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        keys: list[bytes] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])
        for batch in batches:
            for doc_id, whole in zip(batch.column(0), batch.column(1), strict=True):
                own = {line_key(line, least) for line in set(whole.as_py().split("\n"))} - {None}
                keys += own
                ids += [doc_id.as_py()] * len(own)
                if len(ids) > HELD:
                    yield out()
                    ids.clear()
                    keys.clear()
        yield out()

    held = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    return held.mapInArrow(read, "doc_id long, key binary")


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


_COUNT_SCHEMA = "key binary, n long, low long, high long"


@dataclass(frozen=True)
class LineStore:
    """The state after some insertions and deletions; every change returns a new one, whose tables are in the shared folder."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_keys: int = 0
    shards: int = 1
    shard_keys: int = SHARD_KEYS
    least: int = 10

    @classmethod
    def empty(cls, spark: SparkSession, shard_keys: int = SHARD_KEYS, least: int = 10) -> LineStore:
        """``least`` is the number of code points that a line needs to be looked at."""
        made = [spark.createDataFrame([], x) for x in ("doc_id long, key binary", _COUNT_SCHEMA, "shard long, filter binary")]
        return cls(*made, shard_keys=shard_keys, least=least)

    def _shard(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)))

    def _changed(self, refs: DataFrame, counts: DataFrame, added: DataFrame | None, removed: DataFrame | None) -> LineStore:
        """The store with these tables; its filters follow, or are made anew with more shards where keys have outgrown them."""
        counts = materialize(counts, "line-counts")
        n = counts.count()
        shards = self.shards
        while n > shards * self.shard_keys:
            shards *= 2
        out = LineStore(refs, counts, self.filters, n, shards, self.shard_keys, self.least)
        size = self.shard_keys

        def follow(add: bool):
            def run(keys: pa.Table, held: pa.Table) -> pa.Table:
                own = CuckooFilter.from_bytes(held["filter"][0].as_py()) if len(held) else CuckooFilter(size)
                shard = (held if len(held) else keys)["shard"][0].as_py()
                (own.add if add else own.remove)(_hashes(keys["key"]))
                return pa.table({"shard": [shard], "filter": [own.to_bytes()]})

            return run

        old = self.filters
        if shards != self.shards:
            added, removed, old = counts, None, self.filters.limit(0)
        for keys, add in ((removed, False), (added, True)):
            if keys is not None:
                dealt = out._shard(keys.select("key")).groupBy("shard").cogroup(old.groupBy("shard"))
                old = materialize(dealt.applyInArrow(follow(add), "shard long, filter binary"), "line-filters")
        return LineStore(refs, counts, old, n, shards, self.shard_keys, self.least)

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys``, binary ``key`` among its columns, with ``seen``: false for keys that are not in the store for certain. Keys must be distinct."""
        if not self.n_keys:
            return keys.withColumn("seen", F.lit(False))

        def probe(own: pa.Table, held: pa.Table) -> pa.Table:
            found = CuckooFilter.from_bytes(held["filter"][0].as_py()).contains(_hashes(own["key"])) if len(held) else np.zeros(len(own), bool)
            return own.append_column("seen", pa.array(found))

        dealt = self._shard(keys)
        schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", seen boolean"
        return dealt.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, schema).drop("shard")

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineStore:
        """The store with these documents. A doc_id that is stored already gains the references of its further rows.

        Null and empty texts, and rows without id, have no references; empty tables change nothing.
        """
        new = materialize(references(docs, self.least, key, text), "line-refs")
        batch = self.seen(_count(new))
        if not self.n_keys:
            return self._changed(new, batch.drop("seen"), batch, None)
        batch = materialize(batch, "line-batch")
        maybe, fresh = batch.where("seen").drop("seen"), batch.where("NOT seen").drop("seen")
        old = self.counts.select("key", *[F.col(c).alias(f"old_{c}") for c in ("n", "low", "high")])
        both = materialize(maybe.join(old, "key", "left"), "line-both")
        merged = both.select("key", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high"))
        counts = self.counts.join(maybe.select("key"), "key", "left_anti").unionByName(merged).unionByName(fresh)
        added = fresh.select("key").unionByName(both.where("old_n IS NULL").select("key"))  # the false alarms are new as well
        return self._changed(self.refs.unionByName(new), counts, added, None)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> LineStore:
        """The store without the documents of these ids; ids that it does not hold change nothing."""
        gone_ids = ids.select(F.col(key).cast("long").alias("doc_id")).distinct()
        touched = materialize(self.refs.join(gone_ids, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        refs = materialize(self.refs.join(gone_ids, "doc_id", "left_anti"), "line-refs")
        left = materialize(_count(refs.join(touched, "key", "left_semi")), "line-left")
        counts = self.counts.join(touched, "key", "left_anti").unionByName(left)
        return self._changed(refs, counts, None, touched.join(left.select("key"), "key", "left_anti"))

    def drops(self) -> DataFrame:
        """``(doc_id, key)``: lines that a smaller document holds as well."""
        repeated = self.counts.where("low < high").select("key", "low")
        return self.refs.join(repeated, "key").where("doc_id > low").select("doc_id", "key")

    def clean(self, docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "cleaned") -> DataFrame:
        """``docs`` with ``out``: a struct of the kept text, n_lines (before) and n_dropped.

        Lines of a doc_id that the store says to drop go from all rows of that id; all other rows keep all lines. Null texts count as empty, of one empty line.
        """
        least = self.least

        @F.pandas_udf("kept string, n_lines long, n_dropped long")
        def cleaned(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
            rows = []
            for whole, own in zip(texts, keys, strict=True):
                lines = (whole or "").split("\n")
                gone = set() if own is None else set(own)
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

        held, at = free_name(docs, "_keys"), free_name(docs, "_of")
        own = self.drops().groupBy(F.col("doc_id").alias(at)).agg(F.collect_set("key").alias(held))
        joined = docs.join(own, F.col(key).cast("long") == F.col(at), "left")
        return joined.select(*[F.col(c) for c in docs.columns], cleaned(F.col(text), F.col(held)).alias(out))

    def save(self, path: str) -> None:
        for name, df in (("refs", self.refs), ("counts", self.counts), ("filters", self.filters)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = (self.n_keys, self.shards, self.shard_keys, self.least)
        self.refs.sparkSession.createDataFrame([row], "n_keys long, shards long, shard_keys long, least long").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineStore:
        return cls(*[spark.read.parquet(f"{path}/{x}") for x in ("refs", "counts", "filters")], **spark.read.parquet(f"{path}/settings").first().asDict())
