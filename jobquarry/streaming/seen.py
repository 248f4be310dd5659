"""The set of keys seen by all earlier runs, as a table that a micro-batch reads in part.

Keys are dealt over a fixed number of buckets by their hash. Per bucket there are

* *parts*: Parquet files with the keys, one for each batch that brought new ones; a batch
  that would make them more than ``MAX_PARTS`` merges them into its own;
* *filters*: a chain of Bloom filters of ``filter_bits`` bits. The last one takes new keys
  until half of its bits are set, then another follows, so their error stays bounded.

A batch asks the filters of its buckets first. Keys they do not know are new; the parts of
a bucket are read only where a filter knows one of the batch's keys, and then decide. A
manifest, one row per bucket, says which parts and filters count. Each batch writes folders
of its own and its manifest last: a batch that dies leaves nothing that counts, and one that
is run again starts from the same manifest and gives the same result. Folders that no later
manifest names may be removed at any time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from jobquarry.session import stored

#: Bits asked per key: with half of them set, about one unknown key in 128 is taken for known.
PROBES = 7
MAX_PARTS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)

MANIFEST = "bucket int, parts array<long>, filters_in long, parts_read int, filters_read int"
FILTERS = "bucket int, place int, bits binary"


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit numbers per hash, from two halves of it."""
    step = (hashes * _MIX) | np.uint64(1)
    probe = np.arange(PROBES, dtype=np.uint64)
    return ((hashes[:, None] >> np.uint64(7)) + probe * step[:, None]) % np.uint64(bits)


def _chain(table: pa.Table) -> list[np.ndarray]:
    order = np.argsort(table.column("place").to_numpy()) if table.num_rows else []
    return [np.frombuffer(table.column("bits")[int(i)].as_py(), np.uint8).copy() for i in order]


def _hashes(table: pa.Table) -> np.ndarray:
    return table.column("hash").to_numpy().astype(np.int64).view(np.uint64)


def _known(bits: int):
    def known(keys: pa.Table, filters: pa.Table) -> pa.Table:
        at = _positions(_hashes(keys), bits)
        found = np.zeros(keys.num_rows, bool)
        for one in _chain(filters):
            found |= ((one[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return keys.append_column("suspect", pa.array(found))

    return known


def _extended(bits: int):
    def extended(keys: pa.Table, filters: pa.Table) -> pa.Table:
        chain = _chain(filters) or [np.zeros(bits // 8, np.uint8)]
        hashes = _hashes(keys)
        # Half of the bits are set after about bits * ln 2 / PROBES keys.
        room = max(1, int(bits * math.log(2) / PROBES))
        while len(hashes):
            taken = int(math.log(max(1e-9, 1 - np.unpackbits(chain[-1]).mean())) / math.log(1 - 1 / bits) / PROBES)
            if taken >= room:
                chain.append(np.zeros(bits // 8, np.uint8))
                taken = 0
            now, hashes = hashes[: room - taken], hashes[room - taken :]
            at = _positions(now, bits).ravel()
            np.bitwise_or.at(chain[-1], at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bucket = keys.column("bucket")[0].as_py()
        return pa.table(
            {"bucket": pa.array([bucket] * len(chain), pa.int32()), "place": pa.array(range(len(chain)), pa.int32()), "bits": pa.array([c.tobytes() for c in chain], pa.binary())}
        )

    return extended


class SeenSet:
    """Keys seen so far, below ``path``. ``buckets`` and ``filter_bits`` stay as they were first.

    ``buckets``: as many as let the keys of one fit a task (a few million) at the size the
    set is to reach. ``filter_bits``: about ten per key and bucket of a usual run.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, filter_bits: int = 1 << 17):
        if buckets < 1 or filter_bits % 8 or filter_bits < 64:
            raise ValueError("at least one bucket, and filters of whole bytes, 64 bits or more")
        self.spark, self.path = spark, path.rstrip("/")
        layout = self._read("layout", "buckets int, filter_bits int")
        kept = layout.first() if layout is not None else None
        if kept is None:
            spark.createDataFrame([(buckets, filter_bits)], "buckets int, filter_bits int").coalesce(1).write.mode("overwrite").json(f"{self.path}/layout")
        self.buckets, self.filter_bits = (kept.buckets, kept.filter_bits) if kept else (buckets, filter_bits)

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{name}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def bucket_of(self, hash_: Column) -> Column:
        return F.pmod(hash_, F.lit(self.buckets)).cast("int")

    def manifest(self, before: int) -> dict[int, tuple[list[int], int]]:
        """Parts and the batch of the filters of each bucket, as of the batches before this one."""
        # The batch before this one, as a rule; a set that missed some has to look for the last.
        last = self._read(f"manifest/batch_id={before - 1}", MANIFEST)
        if last is None and (every := self._read("manifest", f"{MANIFEST}, batch_id long")) is not None:
            earlier = every.where(F.col("batch_id") < before)
            last = earlier.where(F.col("batch_id") == earlier.agg(F.max("batch_id")).first()[0])
        # One row per bucket.
        return {r.bucket: (list(r.parts), r.filters_in) for r in last.collect()} if last is not None else {}

    def _folders(self, name: str, where: Iterable[tuple[int, int]], schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch_id={batch}/bucket={bucket}" for batch, bucket in where]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return found.select(*(f.name for f in self.spark.createDataFrame([], schema).schema))

    def _numbers(self, df: DataFrame) -> list[int]:
        """Bucket numbers: as many as there are buckets at most."""
        return sorted(r.bucket for r in df.select("bucket").distinct().collect())

    def add(self, batch: DataFrame, key: str, batch_id: int) -> DataFrame:
        """The rows of ``batch`` (each key once) whose key no earlier batch had; they are noted.

        Null keys are one key. The result is a stored table; nothing counts as seen before
        the manifest, which is the last thing written.
        """
        kind = batch.schema[key].dataType.simpleString()
        hash_ = F.xxhash64(F.col(key).isNull(), key)
        rows = stored(batch.withColumn("hash", hash_).withColumn("bucket", self.bucket_of(F.col("hash"))), "batch")
        manifest = self.manifest(batch_id)
        touched = [b for b in self._numbers(rows) if b in manifest]
        keyed = f"bucket int, hash long, key {kind}"
        fresh, read = self._unknown(rows, key, keyed, manifest, touched) if touched else (rows, 0)
        self._note(fresh.select("bucket", "hash", F.col(key).alias("key")), keyed, manifest, batch_id, read, len(touched))
        return fresh.select(*batch.columns)

    def _unknown(self, rows: DataFrame, key: str, keyed: str, manifest: dict, touched: list[int]) -> tuple[DataFrame, int]:
        """The rows no earlier batch had, stored, and how many parts were read to tell."""
        filters = self._folders("filters", ((manifest[b][1], b) for b in touched), FILTERS)
        asked = rows.select("bucket", "hash", F.col(key).alias("key"))
        judged = stored(
            asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_known(self.filter_bits), f"{keyed}, suspect boolean"), "judged"
        )
        doubtful = [b for b in self._numbers(judged.where("suspect")) if b in manifest]
        read = [(p, b) for b in doubtful for p in manifest[b][0]]
        seen = self._folders("parts", read, keyed)
        j, s = judged.where("suspect").alias("j"), seen.alias("s")
        known = j.join(s, (F.col("j.hash") == F.col("s.hash")) & F.col("j.key").eqNullSafe(F.col("s.key")), "left_semi")
        known = stored(known.select("hash", F.col("key").alias("known_key")), "known")
        fresh = rows.join(known, (rows["hash"] == known["hash"]) & rows[key].eqNullSafe(known["known_key"]), "left_anti")
        return stored(fresh, "fresh"), len(read)

    def _note(self, new: DataFrame, keyed: str, manifest: dict, batch_id: int, parts_read: int, filters_read: int) -> None:
        changed = self._numbers(new)
        old = self._folders("filters", ((manifest[b][1], b) for b in changed if b in manifest), FILTERS)
        filters = new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_extended(self.filter_bits), FILTERS)
        filters.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/batch_id={batch_id}")
        merged = [b for b in changed if b in manifest and len(manifest[b][0]) >= MAX_PARTS]
        parts = new.unionByName(self._folders("parts", ((p, b) for b in merged for p in manifest[b][0]), keyed))
        parts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/parts/batch_id={batch_id}")
        now = dict(manifest)
        for b in changed:
            before = [] if b in merged else now.get(b, ([], 0))[0]
            now[b] = ([*before, batch_id], batch_id)
        rows = [(b, p, f, parts_read, filters_read) for b, (p, f) in now.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch_id={batch_id}")
