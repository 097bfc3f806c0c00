"""Which keys a growing table holds, answered without reading the table.

The keys that a batch adds are one segment: files for each bucket of the keys' hashes, and beside them a Bloom filter for each cell of a bucket. A new batch reads the filters of the buckets that its keys
fall into, and opens only those key files whose filter says that one of its keys may be there; equality is settled on the keys themselves. Segments merge like the
digits of a binary counter, so there are about log2(batches) of them, and a key is rewritten as often.

A batch sees only segments that end before it, and its own segment is overwritten, so a batch that is replayed finds and leaves what it did the first time. What reaches the driver
is a list of (segment, bucket) pairs: at most buckets times segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filter bits a key and places that it sets: about one false hit in 70,000.
BITS, PLACES = 24, 12
#: Hashes whose places are held at once, and the cells of a bucket: each has its own filter, so that no task holds those of a whole bucket.
CHUNK, CELLS = 1 << 16, 64
#: Key files of a bucket in a segment.
FILES = 4
STEP = np.uint64(0x9E3779B97F4A7C15)


def _spots(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` bits, one row a hash."""
    first = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        second = (first ^ (first >> np.uint64(29))) * STEP | np.uint64(1)
        mixed = first[:, None] + second[:, None] * np.arange(PLACES, dtype=np.uint64)[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= STEP
    return ((mixed >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def _chunks(hashes: np.ndarray) -> list[np.ndarray]:
    return [hashes[i : i + CHUNK] for i in range(0, len(hashes), CHUNK)]


def bloom(hashes: np.ndarray) -> bytes:
    size = max(64, -(-BITS * len(hashes) // 8) * 8)
    bits = np.zeros(size >> 3, np.uint8)
    for some in _chunks(hashes):
        spots = _spots(some, size).ravel()
        np.bitwise_or.at(bits, spots >> 3, np.uint8(128) >> (spots & 7).astype(np.uint8))
    return bits.tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_, np.uint8)
    hit = [np.zeros(0, bool)]
    for some in _chunks(hashes):
        spots = _spots(some, 8 * len(bits))
        hit.append(((bits[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1).all(axis=1))
    return np.concatenate(hit)


def _filter_of(table: pa.Table) -> pa.Table:
    hashes = np.asarray(table.column("h").combine_chunks())
    return pa.table({"bucket": table.column("bucket")[:1], "cell": table.column("cell")[:1], "keys": pa.array([len(hashes)], pa.int64()), "bits": pa.array([bloom(hashes)], pa.binary())})


def _hits(asked: pa.Table, filters: pa.Table) -> pa.Table:
    hashes = np.asarray(asked.column("h").combine_chunks())
    hit = [bool(len(hashes)) and bool(may_hold(b.as_py(), hashes).any()) for b in filters.column("bits")]
    return filters.select(["segment", "bucket"]).append_column("hit", pa.array(hit, pa.bool_()))


@dataclass(frozen=True)
class Lookup:
    """``known``: keys found in the files that were opened; how many key files there are, and how many were opened."""

    known: DataFrame
    files: int
    opened: int


@dataclass(frozen=True)
class KeyStore:
    """Keys of column ``key`` under folder ``root``. ``buckets`` must stay the same for a folder; ``look_back``: batches before which segments are no longer looked at (None: all are)."""

    root: str
    key: str
    buckets: int = 64
    look_back: int | None = None

    def _fs(self, spark: SparkSession, path: str):
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(spark._jsc.hadoopConfiguration()), made

    def segments(self, spark: SparkSession, before: int) -> list[tuple[int, int]]:
        """Whole segments (first and last batch) that end before a batch and lie in no other one."""
        fs, path = self._fs(spark, f"{self.root}/filters")
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = re.fullmatch(r"segment=(\d+)_(\d+)", status.getPath().getName())
            if name and int(name[2]) < before and fs.exists(self._fs(spark, f"{self.root}/filters/{name[0]}/_SUCCESS")[1]):
                found.append((int(name[1]), int(name[2])))
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def _hashed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64(F.col(self.key))
        # Cells go by other bits of the hash than buckets.
        cell = F.pmod(F.shiftrightunsigned("h", 40), F.lit(CELLS)).cast("int")
        return keys.select(self.key).withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int")).withColumn("cell", cell)

    def nothing(self, keys: DataFrame) -> Lookup:
        return Lookup(keys.sparkSession.createDataFrame([], keys.select(self.key).schema), 0, 0)

    def lookup(self, keys: DataFrame, batch: int) -> Lookup:
        """Which of ``keys`` an earlier batch stored, and what it took to find out. Null keys are never stored."""
        spark = keys.sparkSession
        live = self.segments(spark, batch)
        if self.look_back is not None:
            live = [s for s in live if s[1] >= batch - self.look_back]
        if not live:
            return self.nothing(keys)
        nothing = self.nothing(keys).known
        # Folder names give the segment, and for keys the bucket, as columns.
        read = lambda part, schema, paths: spark.read.option("basePath", f"{self.root}/{part}").schema(schema).parquet(*paths)
        filters = read("filters", "bucket int, cell int, keys long, bits binary", [f"{self.root}/filters/segment={a}_{b}" for a, b in live])
        asked = self._hashed(keys.where(F.col(self.key).isNotNull())).select("bucket", "cell", "h")
        at = ["bucket", "cell"]
        hits = asked.groupBy(*at).cogroup(filters.groupBy(*at)).applyInArrow(_hits, "segment string, bucket int, hit boolean")
        # One row a segment and bucket.
        found = hits.groupBy("segment", "bucket").agg(F.bool_or("hit").alias("hit")).collect()
        paths = [f"{self.root}/keys/segment={r['segment']}/bucket={r['bucket']}" for r in found if r["hit"]]
        return Lookup(read("keys", nothing.schema, paths).select(self.key) if paths else nothing, len(found), len(paths))

    def add(self, keys: DataFrame, first: int, last: int | None = None) -> None:
        """Store the segment of batch ``first`` (to ``last``); a key that comes twice only takes more room. Filters come last and make it whole."""
        name = f"segment={first}_{first if last is None else last}"
        hashed = self._hashed(keys.where(F.col(self.key).isNotNull()))
        dealt = hashed.select(self.key, "bucket", "cell").repartition("bucket", F.col("cell") % FILES).drop("cell")
        dealt.sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/{name}")
        made = hashed.select("bucket", "cell", "h").groupBy("bucket", "cell").applyInArrow(_filter_of, "bucket int, cell int, keys long, bits binary")
        made.write.mode("overwrite").parquet(f"{self.root}/filters/{name}")

    def compact(self, spark: SparkSession, before: int, key_type: str) -> int:
        """Merge segments of one length that end before a batch, until all differ; the merged ones are deleted. Returns the number of merges."""
        merges = 0
        while True:
            live = self.segments(spark, before)
            pair = next(((a, b) for a, b in zip(live[-2::-1], live[:0:-1]) if b[1] - b[0] >= a[1] - a[0]), None)
            if pair is None:
                return merges
            (first, _), (_, last) = pair
            paths = [p for a, b in pair for p in [f"{self.root}/keys/segment={a}_{b}"] if self._has_files(spark, p)]
            schema = f"{self.key} {key_type}"
            kept = spark.read.option("basePath", f"{self.root}/keys").schema(schema).parquet(*paths).select(self.key) if paths else spark.createDataFrame([], schema)
            self.add(kept, first, last)
            for a, b in pair:
                for part in ("filters", "keys"):
                    fs, path = self._fs(spark, f"{self.root}/{part}/segment={a}_{b}")
                    fs.delete(path, True)
            merges += 1

    def _has_files(self, spark: SparkSession, path: str) -> bool:
        fs, made = self._fs(spark, path)
        return fs.exists(made) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(made))
