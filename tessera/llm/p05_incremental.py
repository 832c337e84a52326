"""Problem 5: new batches against all history, by mailbox.

The history is a forest of prefix trees over hash signatures, kept in a folder that any later application
can open. Each address has a signature in every tree: hashes of what is left of its domain and local part
without one block of letters, then hashes of the whole parts, so that a single slip in a part leaves a prefix
of one tree's signature whole (see ``mailboxes``). All signatures of a run stand sorted in one key space,
range-partitioned into files; the manifest holds the first and last key of every file.

A look-up turns each address into prefixes. A prefix is an aligned range of keys: the files whose keys can
lie in such a range are found by a search in the manifest's bounds, only those are read, and a merge join over the sorted
prefixes finds the entries of each range, which are verified letter by letter. Prefixes are widened step by
step (whole signature, then all but a block of the local part, then all but a block of both parts) until the
depth whose recall reaches the target; what was found at one depth is not looked up at the next. The last
depth finds every address with at most one slip in each part, by construction (tested): recall 1.

Entries carry the number of the batch that brought them first, so several batches that arrive together are
appended and looked up at once, each against lower numbers only; batch by batch gives the same rows. Runs
are merged in tiers of ``FAN``: an entry is rewritten once a tier. Runs that were merged are deleted.

Hot keys: copies fall together before any look-up, so a mailbox with a third of all rows is one entry; the
join back to the rows has one row per mailbox on one side, which AQE splits.

Defined cases: rows without an address are never repeats; rows of one batch do not count against each
other; a null batch number is a last batch of its own; repeated rows are all reported; empty tables
give empty results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, new_path, written
from .mailboxes import ANY_SLIP, EXACT, SAME_DOMAIN, mailbox, same_but_slip, with_keys, with_whole_key
from .p02_formatting_duplicates import complete_address

# Depths (bits left off a signature) with the recall that each one reaches for addresses with a slip in
# the local part, a slip in the domain, a slip in both: the least of them decides.
DEPTHS = ((EXACT, 0.0), (SAME_DOMAIN, 0.0), (ANY_SLIP, 1.0))
FAN = 4
LAST_BATCH = (1 << 31) - 1
RUN = "key bigint, box string, batch int"


class HashForest:
    """A persisted forest: ``HashForest(spark, path)`` opens it, or starts one if the folder has none."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "forest")
        self.version, self.runs = 0, []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at())] if self._fs.exists(self._at()) else []
        if held := [int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")]:
            self.version = max(held)
            text = spark.read.text(f"{self.path}/manifest-{self.version}.json", wholetext=True).first()[0]
            self.runs = json.loads(text)

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _save(self) -> None:
        """A new manifest, written aside and renamed: a reader sees the old one or the new one."""
        draft = self._at(f"draft-{self.version + 1}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(self.runs).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"manifest-{self.version + 1}.json")):
            raise RuntimeError("another writer has changed the forest")
        self._fs.delete(self._at(f"manifest-{self.version - 1}.json"), False)
        self.version += 1

    def rows(self) -> int:
        return sum(f[3] for r in self.runs for f in r["files"])

    def _write(self, entries: DataFrame, level: int) -> None:
        """Add entries (key, box, batch) as a run, sorted and range-partitioned by key."""
        name = f"run-{self.version + 1}-{len(self.runs)}"
        entries.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        run = self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")
        files = run.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
        held = [[r.f, r.lo, r.hi, r.n] for r in files.collect()]  # one row per file
        if held:
            self.runs.append({"name": name, "level": level, "files": sorted(held, key=lambda f: f[1:3])})

    def append(self, boxes: DataFrame) -> None:
        """Add mailboxes (box, batch), each once, as a run; then merge tiers that are full."""
        self._write(with_keys(boxes.select("box", F.col("batch").cast("int").alias("batch")), False).select("key", "box", "batch"), 0)
        self._save()
        while self.runs and (full := [r for r in self.runs if r["level"] == min(x["level"] for x in self.runs)]) and len(full) >= FAN:
            self.merge(full)

    def merge(self, runs: list[dict] | None = None) -> None:
        """Merge runs (all by default) into one of the next tier and delete them; an address keeps its lowest batch."""
        runs = self.runs if runs is None else runs
        gone = [r["name"] for r in runs]
        if len(gone) < 2:
            return
        merged = self._read([(r["name"], f) for r in runs for f in r["files"]]).groupBy("key", "box").agg(F.min("batch").alias("batch"))
        self._write(merged, max(r["level"] for r in runs) + 1)
        self.runs = [r for r in self.runs if r["name"] not in gone]
        self._save()
        for name in gone:
            self._fs.delete(self._at(name), True)

    def _read(self, files: list[tuple[str, list]]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{run}/{f[0]}" for run, f in files])

    def touched(self, asked: DataFrame, widened: int) -> list[tuple[str, list]]:
        """(run, file) of those files that hold keys in the range of a prefix of ``asked`` (column box). The bounds
        of the files travel to the tasks, file numbers come back: one for each touched file and task."""
        runs = [(r["name"], r["files"]) for r in self.runs]
        bounds = [(np.array([f[1] for f in files]), np.array([f[2] for f in files])) for _, files in runs]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hit = [np.zeros(len(lo) + 1, np.int64) for lo, _ in bounds]
            for batch in batches:
                first = np.unique(batch.column(0).to_numpy(zero_copy_only=False)) << widened
                last = first + ((1 << widened) - 1)
                for (lo, hi), h in zip(bounds, hit, strict=True):
                    a, b = np.searchsorted(hi, first, "left"), np.searchsorted(lo, last, "right")
                    inside = a < b
                    np.add.at(h, a[inside], 1)
                    np.add.at(h, b[inside], -1)
            for k, h in enumerate(hit):
                files = np.flatnonzero(np.cumsum(h)[:-1] > 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(files), k, np.int32)), pa.array(files)], names=["run", "file"])

        keys = with_whole_key(asked.select("box")) if widened == EXACT else with_keys(asked.select("box"), True, widened)
        found = keys.select("key").mapInArrow(search, "run int, file int").distinct().collect()
        return sorted((runs[r.run][0], runs[r.run][1][r.file]) for r in found)

    def _held(self, asked: DataFrame, widened: int) -> DataFrame:
        """Entries of the touched files."""
        return self._read(self.touched(asked, widened)).select("key", F.col("box").alias("held"), F.col("batch").alias("since"))

    def known(self, asked: DataFrame) -> DataFrame:
        """Those of ``asked`` (box, batch) whose very address stands in the forest with a lower batch."""
        held = self._held(asked, EXACT)
        met = with_whole_key(asked).join(held, "key").filter("box = held and since < batch")
        return met.select("box", "batch").distinct()

    def slipped(self, asked: DataFrame, widened: int) -> DataFrame:
        """Those of ``asked`` that are one slip in a part away from an entry of a lower batch, by prefixes ``widened`` bits shorter."""
        held = self._held(asked, widened).withColumn("key", F.shiftright("key", widened))
        met = with_keys(asked, True, widened).join(held, "key").filter("since < batch").filter(same_but_slip(F.col("box"), F.col("held")))
        return met.select("box", "batch").distinct()

    def check(self, boxes: DataFrame, recall: float = 1.0) -> list[DataFrame]:
        """Look mailboxes (box, batch; each box once, with its lowest batch) up and append the new ones. Returns
        written tables (box) of those that were met, one per depth."""
        boxes = written(boxes.select("box", "batch"), "asked")
        met = [written(self.known(boxes), "known")]
        new = boxes.join(met[0], ["box", "batch"], "left_anti")
        self.append(new)
        for widened, reached in DEPTHS:
            if widened != EXACT:
                met.append(written(self.slipped(new, widened), "slipped"))
                new = new.join(met[-1], ["box", "batch"], "left_anti")
            if reached >= recall:
                break
        return met

    def drop(self) -> None:
        self._fs.delete(self._at(), True)


def repeats(forest: HashForest, arriving: DataFrame, id_column: str, batch_column: str, recall: float = 1.0) -> DataFrame:
    """id_column of rows whose mailbox (column box) is in the forest or a lower batch of ``arriving``; the
    forest then holds them too."""
    rows = written(arriving.filter("box is not null").select(id_column, "box", F.coalesce(F.col(batch_column).cast("int"), F.lit(LAST_BATCH)).alias("batch")), "arriving")
    first = written(rows.groupBy("box").agg(F.min("batch").alias("batch")), "first")
    met = forest.check(first, recall)
    seen = met[0].select("box")
    for m in met[1:]:
        seen = seen.unionAll(m.select("box"))
    first = first.withColumnRenamed("batch", "first").join(seen.withColumn("seen", F.lit(True)), "box", "left")
    out = written(rows.join(first, "box").filter("seen or batch > first").select(id_column), "repeats")
    discard(rows, *met)
    return out


def history(spark: SparkSession, boxes: DataFrame) -> HashForest:
    """A forest of the distinct mailboxes of ``boxes`` (column box), older than any batch."""
    forest = HashForest(spark)
    forest.append(boxes.filter("box is not null").select("box").distinct().withColumn("batch", F.lit(-(1 << 31))))
    return forest


def _tables(contacts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = contacts.filter(complete_address(F.col("email"))).select(mailbox(F.col("email")).alias("box"))
    return held, hits.select("hit_id", "batch_no", mailbox(F.col("email")).alias("box"))


def hits_found(contacts: DataFrame, hits: DataFrame) -> DataFrame:
    """hit_id of hits whose mailbox is in contacts or in a lower batch: all batches at once."""
    held, arriving = _tables(contacts, hits)
    forest = history(hits.sparkSession, held)
    out = repeats(forest, arriving, "hit_id", "batch_no")
    forest.drop()
    return out


def hits_by_batch(contacts: DataFrame, hits: DataFrame) -> DataFrame:
    """hit_id, batch_no of the same rows, one batch after another; each opens the forest anew, as a later
    application would."""
    spark = hits.sparkSession
    held, arriving = _tables(contacts, hits)
    at = history(spark, held).path
    arriving = written(arriving, "batches")
    numbers = [r[0] for r in arriving.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_last()).collect()]  # one per batch
    out = spark.createDataFrame([], "hit_id bigint, batch_no int")
    for b in numbers:
        batch = arriving.filter(F.col("batch_no").eqNullSafe(F.lit(b).cast("int")))
        out = out.unionAll(repeats(HashForest(spark, at), batch, "hit_id", "batch_no").select("hit_id", F.lit(b).cast("int").alias("batch_no")))
    HashForest(spark, at).drop()
    return out
