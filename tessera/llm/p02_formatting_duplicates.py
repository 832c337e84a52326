"""Problem 2: records that differ only in dress become one record with its number of copies.

Pass 1 builds, per partition, two Bloom filters of canonical hashes: one of hashes seen, one of
hashes seen again. Filters merge as (A, B) + (A', B') = (A | A', B | B' | (A & A')), which keeps
every hash that two partitions share. Pass 2 sends only rows that the merged second filter may
contain through the shuffle for exact grouping; every other row is a record of its own.

Rows are keyed once and written in parts by hash, as many as it takes for a part's filter of ``BITS_PER_ROW`` bits
a row to stay within ``MAX_BITS`` (a broadcast of 64 MB). The parts are filtered one after another, each reading its
own files only, so the filter is as selective for billions of rows as for thousands, and nothing grows but the
number of parts.

Defined cases: null, empty or incomplete e-mails make a row a record of its own; a null name has no
parts and agrees only with other names without parts; rows of problem 1 are records of their own;
repeated ids count as separate copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path, written
from .p01_canonical_text import with_canonical

MAX_BITS = 1 << 29
BITS_PER_ROW = 16
SLICE = 8192
SALTS = 8

COMPLETE = r"^[^@]*[\p{L}\p{N}][^@]*@[^@]*[\p{L}\p{N}]\.[\p{L}\p{N}][^@]*$"


def complete_address(column: Column) -> Column:
    """Text before one @ and a dotted name after it."""
    return F.coalesce(column.rlike(COMPLETE), F.lit(False))


def email_key(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))


def name_key(column: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_join(F.array_sort(parts), " ")


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    return [(u & np.uint64(bits - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def _has(bitmap: np.ndarray, positions: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(positions[0]), dtype=bool)
    for p in positions:
        out &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def _set(bitmap: np.ndarray, positions: list[np.ndarray]) -> None:
    for p in positions:
        np.bitwise_or.at(bitmap, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))


def _build(bits: int, lanes: int):
    schema = pa.schema([("slice", pa.int32()), ("lane", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % lanes
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if not len(h):
                continue
            at = _positions(h, bits)
            repeated = _has(once, at) | (n > 1)
            _set(again, [p[repeated] for p in at])
            _set(once, at)
        for k in np.flatnonzero(once.reshape(-1, min(SLICE, len(once))).any(axis=1)):
            a, b = k * SLICE, (k + 1) * SLICE
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k)], pa.int32()), pa.array([lane], pa.int32()), pa.array([once[a:b].tobytes()]), pa.array([again[a:b].tobytes()])],
                schema=schema,
            )

    return build


def _merge(keep_lane: bool):
    def merge(slices: pa.Table) -> pa.Table:
        once = again = None
        for a, b in zip(slices["once"], slices["again"], strict=True):
            x, y = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            once, again = (x, y) if once is None else (once | x, again | y | (once & x))
        return pa.table(
            {
                "slice": pa.array([slices["slice"][0].as_py()], pa.int32()),
                "lane": pa.array([slices["lane"][0].as_py() if keep_lane else 0], pa.int32()),
                "once": pa.array([once.tobytes()]),
                "again": pa.array([again.tobytes()]),
            }
        )

    return merge


def possible_repeats(hashed: DataFrame, rows: int, column: str = "__h", lanes: int = 32) -> Column:
    """A condition that holds for every one of ``rows`` rows whose hash occurs more than once, and for few others."""
    spark = hashed.sparkSession
    bits = 1 << max(16, (max(1, rows * BITS_PER_ROW) - 1).bit_length())
    kind = "slice int, lane int, once binary, again binary"
    parts = hashed.select(column).mapInArrow(_build(bits, lanes), kind)
    merged = parts.groupBy("slice", "lane").applyInArrow(_merge(True), kind).groupBy("slice").applyInArrow(_merge(False), kind)
    again = np.zeros(bits // 8, np.uint8)
    for row in merged.select("slice", "again").collect():  # the filter of one part: at most MAX_BITS / 4 bytes
        again[row.slice * SLICE : row.slice * SLICE + len(row.again)] = np.frombuffer(row.again, np.uint8)
    held = spark.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(_has(held.value, _positions(h.to_numpy(np.int64), bits)))

    return maybe(F.col(column))


def keyed_contacts(contacts: DataFrame) -> DataFrame:
    """contact_id with the two keys; keys are null where a row can have no copy."""
    named = with_canonical(contacts.select("contact_id", "name", "email"), "name", "__c", "__styled")
    can = complete_address(F.col("email")) & ~F.col("__styled")
    return named.select("contact_id", F.when(can, email_key(F.col("email"))).alias("ek"), F.when(can, name_key(F.col("name"))).alias("nk"))


def divided(contacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that may have copies, with their keys; ids of rows that have none; groups of two or more rows: ek, nk, first_id,
    copies). Only the first go through a shuffle."""
    spark, at = contacts.sparkSession, new_path(contacts.sparkSession, "keyed")
    n_parts = max(1, -(-contacts.count() * BITS_PER_ROW // MAX_BITS))
    keyed = keyed_contacts(contacts).withColumn("__h", F.when(F.col("ek").isNotNull(), F.xxhash64("ek", "nk")))
    keyed = keyed.withColumn("__part", F.coalesce(F.pmod(F.shiftright("__h", 20), F.lit(n_parts)).cast("int"), F.lit(-1)))
    keyed.write.partitionBy("__part").parquet(at)
    keyed = spark.read.schema(keyed.schema).parquet(at)
    sizes = {r["__part"]: r["n"] for r in keyed.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a part
    maybe, single = keyed.limit(0), keyed.filter("__part = -1").select("contact_id")
    for part, n in sizes.items():
        if part >= 0:
            rows = keyed.filter(F.col("__part") == part)
            rows = rows.withColumn("__maybe", possible_repeats(rows, n))
            maybe = maybe.unionAll(rows.filter("__maybe").drop("__maybe"))
            single = single.unionAll(rows.filter("not __maybe").select("contact_id"))
    maybe = written(maybe.select("contact_id", "ek", "nk"), "maybe")
    groups = maybe.groupBy("ek", "nk").agg(F.min("contact_id").alias("first_id"), F.count("*").alias("copies"))
    return maybe, single, groups


def copies_found(contacts: DataFrame) -> DataFrame:
    """contact_id_a (smallest of its group), contact_id_b for each other copy. The join back is salted,
    so that a group with a third of all rows spreads over tasks."""
    maybe, _, groups = divided(contacts)
    spread = groups.filter("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = maybe.withColumn("salt", F.pmod(F.xxhash64("contact_id"), F.lit(SALTS)).cast("int"))
    return (
        rows.join(spread, ["ek", "nk", "salt"])
        .filter("contact_id <> first_id")
        .select(F.col("first_id").alias("contact_id_a"), F.col("contact_id").alias("contact_id_b"))
    )


def records(contacts: DataFrame) -> DataFrame:
    """One row per record: contact_id (smallest of its copies) and copies. Rows that the filter clears are emitted as they are."""
    _, single, groups = divided(contacts)
    return single.withColumn("copies", F.lit(1).cast("bigint")).unionAll(groups.select("first_id", "copies"))
