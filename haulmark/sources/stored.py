"""Parquet tables with keyed, repeatable merges.

A table is a folder of immutable data folders plus numbered snapshot files; a snapshot lists the
folder that currently holds each partition. A merge writes only the partitions it touches into
a new data folder and then creates the next snapshot, so readers switch in one step, nothing
that is being read is overwritten, and a merge that fails leaves the table as it was.

A table split by month has two companions, listed in the same snapshots and so never out of step:

* the key directory says in which month a key stands. It is hash-bucketed; a merge appends its
  keys and a lookup opens the buckets of the keys it asks for, so no merge reads all keys.
* the ledger holds partial sums. A merge appends those of its new rows less those of the rows
  they replace; readers add up the few appended parts.

A table may also be searched by parts of its ids: postings say which files hold an id with given three letters.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.ledger import Ledger
from haulmark.sources import postings
from haulmark.staging import stage, together

Columns = list[tuple[str, str, bool]]

WHOLE = "all"
MAX_PARTS = 8  # appended parts of a bucket or ledger before they are written as one


def conform(df: DataFrame, columns: Columns) -> DataFrame:
    """Exactly the target columns: absent ones become NULL, NaN becomes NULL."""
    out: list[Column] = []
    for name, kind, _ in columns:
        value = F.lit(None) if name not in df.columns else F.col(name)
        if name in df.columns and df.schema[name].dataType.typeName() in ("double", "float"):
            value = F.when(~F.isnan(name), F.col(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def absent_columns(df: DataFrame, columns: Columns) -> list[str]:
    return sorted({name for name, _, _ in columns} - set(df.columns))


@dataclass
class Snapshot:
    """What a version consists of: folder per month, folders per key bucket, ledger folders and the latest of them,
    folders of postings, and notes of the writer."""

    parts: dict[str, str] = field(default_factory=dict)
    buckets: int = 0
    keys: dict[str, list[str]] = field(default_factory=dict)
    sums: list[str] = field(default_factory=list)
    last_sums: str | None = None
    grams: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)


class StoredTable:
    """A table at ``path`` keyed by ``key``, optionally split by a timestamp column's month.

    ``key_buckets`` counts when the table is first written; choose it so that a bucket's keys fit a task. By default
    there are as many as shuffle partitions.
    """

    def __init__(
        self, spark: SparkSession, path: str, columns: Columns, key: str, month_of: str | None = None,
        stamps: tuple[str, ...] = (), cluster_by: str | None = None, ledger: Ledger | None = None,
        key_buckets: int | None = None, search_on: tuple[str, ...] = (),
    ):
        self.spark, self.path, self.columns, self.key, self.month_of = spark, path.rstrip("/"), columns, key, month_of
        # Files are sorted by this column, so a filter on it skips row groups; the key gets a bloom filter.
        self.cluster_by = cluster_by
        # Audit columns set by the merge: "created_at" survives updates, "updated_at" does not.
        self.stamps = stamps
        self.ledger, self.key_buckets, self.search_on = ledger, key_buckets, search_on

    # --- snapshots ------------------------------------------------------------------------

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/_snapshots")
        return hadoop, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the current snapshot; 0 before the first merge."""
        _, folder, fs = self._fs()
        if not fs.exists(folder):
            return 0
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return max((int(name[:-5]) for name in names if name.endswith(".json") and name[0] != "."), default=0)

    def _snapshot(self, version: int | None = None) -> Snapshot:
        version = self.version() if version is None else version
        if version == 0:
            return Snapshot()
        hadoop, folder, fs = self._fs()
        stream = fs.open(hadoop.Path(folder, f"{version:08d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(**found) if "parts" in found else Snapshot(parts=found)

    def notes(self) -> dict:
        return self._snapshot().notes

    def _parts(self, version: int) -> dict[str, str]:
        return self._snapshot(version).parts

    def _publish(self, version: int, snapshot: Snapshot) -> None:
        """Create the snapshot file; fails if another merge created the same number first."""
        hadoop, folder, fs = self._fs()
        draft = hadoop.Path(folder, f".{version:08d}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(vars(snapshot), sort_keys=True).encode())
        out.close()
        final = hadoop.Path(folder, f"{version:08d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.path}: version {version} was published by another merge")

    # --- reading --------------------------------------------------------------------------

    def _all_columns(self) -> Columns:
        return self.columns + [(name, "timestamp_ntz", True) for name in self.stamps]

    def _ddl(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind, _ in self._all_columns())

    def _open(self, folders: list[str], ddl: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*folders)

    def _read(self, folders: list[str]) -> DataFrame:
        return self._open(folders, self._ddl())

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The current rows; ``months`` ("2017-05") opens only those partitions."""
        parts = self._snapshot().parts
        return self._read(sorted(f for month, f in parts.items() if months is None or month in months))

    def between(self, first: str, end: str) -> DataFrame:
        """The current rows with a time from ``first`` up to, but without, ``end``; opens only the months in between."""
        months = [m for m in self._snapshot().parts if first[:7] <= m <= end[:7]]
        time, bounds = F.col(self.month_of), [F.lit(x).cast("timestamp_ntz") for x in (first, end)]
        return self.read(months).where((time >= bounds[0]) & (time < bounds[1]))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The stored rows of ``keys``; opens the buckets of these keys and the months they stand in."""
        snapshot = self._snapshot()
        months = self._months(self._located(snapshot, keys, self._buckets_of(snapshot, keys)))
        return self._read(sorted(snapshot.parts[m] for m in months)).join(keys.select(self.key), self.key, "left_semi")

    def search(self, text: str) -> DataFrame:
        """Rows in which an id of ``search_on`` contains ``text``, in any case; opens only files that postings name.

        ``%`` and ``_`` keep their LIKE meaning. Texts without three letters in a row, and those that are not plain
        ASCII, have no postings to look at; all files are searched then.
        """
        found = [F.col(name).ilike(f"%{text}%") for name in self.search_on]
        wanted = reduce(lambda a, b: a | b, found)
        grams = postings.grams_of(text)
        snapshot = self._snapshot()
        if not grams or not snapshot.grams:
            return self.read().where(wanted)
        folders = [f"{f}/bucket={b}" for f in snapshot.grams for b in sorted({postings.bucket_of(g) for g in grams})]
        rows = self._open([f for f in folders if self._exists(f)], postings.DDL)
        files = [row.file for row in postings.candidates(rows, grams).collect()]  # at most the table's files
        current = {postings.below_data(folder) for folder in snapshot.parts.values()}
        return self._read(sorted(f for f in files if postings.below_data(f).rpartition("/")[0] in current)).where(wanted)

    def _add_grams(self, version: int, snapshot: Snapshot, written: list[str]) -> None:
        """Append postings of the files of this merge; many parts are made anew from the current files."""
        anew = len(snapshot.grams) >= MAX_PARTS
        folders = written if not anew else sorted(snapshot.parts.values())
        if folders:
            folder = f"{self.path}/grams/{version:08d}-{uuid.uuid4().hex}"
            rows = postings.of_files(self._read(folders), self.search_on)
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(folder)
            snapshot.grams = [folder] if anew else [*snapshot.grams, folder]

    # --- changes --------------------------------------------------------------------------

    def changes(self, since: int) -> tuple[DataFrame, DataFrame]:
        """Rows that are new or other than in version ``since``, and keys that were there then and are gone.

        Months whose folder is the same in both snapshots are not opened; in the others rows are told apart by a digest.
        """
        then, now = self._snapshot(since).parts, self._snapshot().parts
        months = sorted(m for m in then.keys() | now.keys() if then.get(m) != now.get(m))
        old, new = (self._read([parts[m] for m in months if m in parts]) for parts in (then, now))
        names = [name for name, _, _ in self.columns]
        # A null leaves a hash as it was, so which values are null is hashed as well.
        digest = F.xxhash64(*names, *[F.col(name).isNull() for name in names]).alias("_digest")
        same = old.select(self.key, digest)
        changed = new.withColumn("_digest", digest).join(same, [self.key, "_digest"], "left_anti").drop("_digest")
        return changed, old.select(self.key).join(new.select(self.key), self.key, "left_anti")

    # --- ledger ---------------------------------------------------------------------------

    def sums(self, grain: str) -> DataFrame:
        """Partial sums of the current rows, one row per group of ``grain``; reads no rows of the table."""
        return self._total(self._snapshot().sums, grain)

    def _total(self, folders: list[str], grain: str) -> DataFrame:
        return self.ledger.total(self._sums_in(folders, grain), grain)

    def _sums_in(self, folders: list[str], grain: str) -> DataFrame:
        return self._open([f"{x}/grain={grain}" for x in folders if self._exists(f"{x}/grain={grain}")], self.ledger.ddl())

    def touched(self, grain: str) -> DataFrame:
        """The groups of ``grain`` whose sums the latest merge changed."""
        last = self._snapshot().last_sums
        return self._sums_in([last] if last else [], grain).select(*self.ledger.grains[grain]).distinct()

    def _add_sums(self, version: int, snapshot: Snapshot, added: DataFrame, removed: DataFrame | None) -> None:
        """Append the sums of this merge; many parts are written as one first."""
        folder = f"{self.path}/ledger/{version:08d}-{uuid.uuid4().hex}"
        self.ledger.signed(added, removed).write.partitionBy("grain").parquet(folder)
        snapshot.sums, snapshot.last_sums = [*snapshot.sums, folder], folder
        if len(snapshot.sums) > MAX_PARTS:
            whole = f"{self.path}/ledger/{version:08d}-{uuid.uuid4().hex}"
            for grain in self.ledger.grains:
                self._total(snapshot.sums, grain).write.parquet(f"{whole}/grain={grain}")
            snapshot.sums = [whole]

    # --- key directory --------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _buckets_of(self, snapshot: Snapshot, keys: DataFrame) -> set[int]:
        """Bounded by the number of buckets."""
        if not snapshot.buckets:
            return set()
        return {row.bucket for row in keys.select(self._bucket(snapshot.buckets).alias("bucket")).distinct().collect()}

    def _located(self, snapshot: Snapshot, keys: DataFrame, buckets: set[int]) -> DataFrame:
        """Month of each of ``keys`` that is stored."""
        folders = [f for b in sorted(buckets) for f in snapshot.keys.get(str(b), [])]
        return self._newest(folders, keys).where(F.col("part").isNotNull()).drop("version")

    def _newest(self, folders: list[str], keys: DataFrame | None = None) -> DataFrame:
        rows = self._open(folders, f"`{self.key}` {dict((n, k) for n, k, _ in self.columns)[self.key]}, part string, version int")
        if keys is not None:
            rows = rows.join(keys.select(self.key), self.key, "left_semi")
        newest = F.max_by(F.struct("part", "version"), "version").alias("_at")
        return rows.groupBy(self.key).agg(newest).select(self.key, "_at.part", "_at.version")

    def _months(self, located: DataFrame) -> set[str]:
        """Months are bounded by the calendar, so their names may come to the driver."""
        return {row.part for row in located.select("part").distinct().collect()}

    def _add_keys(self, version: int, snapshot: Snapshot, new: DataFrame, gone: DataFrame | None, buckets: set[int]) -> None:
        """Append the months of new keys and, with a null month, the keys that went. Long buckets are written whole."""
        rows = new.select(self.key, self._month(), F.lit(version).alias("version"))
        if gone is not None:
            lost = gone.join(new.select(self.key), self.key, "left_anti")
            rows = rows.unionByName(lost.select(self.key, F.lit(None).cast("string").alias("part"), F.lit(version).alias("version")))
        long = {b for b in buckets if len(snapshot.keys.get(str(b), [])) >= MAX_PARTS}
        if long:
            old = self._newest([f for b in sorted(long) for f in snapshot.keys[str(b)]]).where(F.col("part").isNotNull())
            rows = rows.unionByName(old.join(rows.select(self.key), self.key, "left_anti"))
        folder = f"{self.path}/keys/{version:08d}-{uuid.uuid4().hex}"
        bucketed = rows.withColumn("bucket", self._bucket(snapshot.buckets)).hint("rebalance", "bucket")
        bucketed.write.partitionBy("bucket").parquet(folder)
        snapshot.keys = dict(snapshot.keys)
        for bucket in map(str, sorted(buckets)):
            if self._exists(f"{folder}/bucket={bucket}"):
                had = [] if int(bucket) in long else snapshot.keys.get(bucket, [])
                snapshot.keys[bucket] = [*had, f"{folder}/bucket={bucket}"]

    # --- merging --------------------------------------------------------------------------

    def _month(self) -> Column:
        month = F.date_format(self.month_of, "yyyy-MM") if self.month_of else F.lit(WHOLE)
        return F.coalesce(month, F.lit("none")).alias("part")

    def _inspect(self, new: DataFrame, buckets: int, unique: bool) -> tuple[set[str], set[int]]:
        """Months and buckets of a batch, both bounded; refuses a batch that holds a key twice."""
        rows = new.select(self.key, self._month(), self._bucket(buckets).alias("bucket"))
        repeated = F.lit(None).cast("string")
        if not unique:
            rows = rows.groupBy(self.key, "bucket").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
            repeated = F.max(F.when(F.col("n") > 1, F.struct("n", F.col(self.key).cast("string").alias("key"))))
        found = rows.groupBy("part").agg(repeated.alias("repeated"), F.collect_set("bucket").alias("buckets")).collect()
        for row in found:
            if row.repeated is not None:
                raise ValueError(f"{self.path}: {self.key} {row.repeated.key!r} stands on {row.repeated.n} rows of one batch")
        return {row.part for row in found}, {b for row in found for b in row.buckets}

    def merge(
        self, rows: DataFrame, as_of: str, stored: bool = False, replacing: DataFrame | None = None, unique: bool = False,
        notes: dict | None = None,
    ) -> int:
        """Insert new keys and replace existing ones; returns the new version.

        ``rows`` must hold each key once, which is checked unless ``unique`` promises it; ``stored`` says they are
        read from files and need not be written once more. Old rows go too if ``replacing`` has their key, whether
        ``rows`` has it or not. Running the same merge again leaves the same rows. ``notes`` are published with it.
        """
        version = self.version()
        snapshot = self._snapshot(version)
        parts = snapshot.parts
        new = conform(rows, self.columns).where(F.col(self.key).isNotNull())
        if not stored:
            new = stage(new, "merge")
        keyed = bool(self.month_of)
        if keyed and not snapshot.buckets:
            snapshot.buckets = self.key_buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            if parts:  # written before there was a directory
                self._add_keys(version, snapshot, self._read(sorted(parts.values())), None, set(range(snapshot.buckets)))
        if self.ledger and parts and snapshot.last_sums is None:  # or a ledger
            self._add_sums(version, snapshot, self._read(sorted(parts.values())), None)
        touched, buckets = {WHOLE}, set()
        if keyed or not unique:
            touched, buckets = self._inspect(new, max(1, snapshot.buckets), unique)
        gone = None
        if parts and keyed:
            # A key may have moved to another month, so its old partition is rewritten as well.
            keys = new.select(self.key)
            if replacing is not None:
                keys = keys.unionByName(replacing.select(self.key))
                buckets |= self._buckets_of(snapshot, replacing)
            gone = stage(self._located(snapshot, keys, buckets), "located")
            touched |= self._months(gone)
        elif parts and replacing is not None:
            touched |= set(parts)
        replaced = sorted(parts[month] for month in touched if month in parts)
        old = self._read(replaced) if replaced else None
        merged = self._stamped(new, as_of) if old is None else self._with_old(new, old, as_of, replacing)

        folder = f"{self.path}/data/{version + 1:08d}-{uuid.uuid4().hex}"
        # Adaptive rebalancing gathers small months into few files and splits large ones by size.
        spread = merged.withColumn("part", self._month()).hint("rebalance", "part")
        writer = spread.write
        if self.cluster_by:
            writer = (
                spread.sortWithinPartitions("part", self.cluster_by)
                .write.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
                .option("parquet.bloom.filter.adaptive.enabled", "true")
            )
        tasks = [lambda: writer.partitionBy("part").parquet(folder)]
        if keyed:
            tasks.append(lambda: self._add_keys(version + 1, snapshot, new, gone, buckets))
        if self.ledger:
            out = None if gone is None or old is None else old.join(gone.select(self.key), self.key, "left_semi")
            tasks.append(lambda: self._add_sums(version + 1, snapshot, new, out))
        together(*tasks)  # none of them is seen before the snapshot is published
        kept = {month: path for month, path in parts.items() if month not in touched}
        written = {name: f"{folder}/part={name}" for name in touched if self._exists(f"{folder}/part={name}")}
        snapshot.parts = kept | written
        if self.search_on:
            self._add_grams(version + 1, snapshot, sorted(written.values()))
        snapshot.notes = snapshot.notes if notes is None else notes
        self._publish(version + 1, snapshot)
        return version + 1

    def _stamped(self, new: DataFrame, as_of: str) -> DataFrame:
        now = F.lit(as_of).cast("timestamp_ntz")
        return new.withColumns({name: now for name in self.stamps}) if self.stamps else new

    def _with_old(self, new: DataFrame, old: DataFrame, as_of: str, replacing: DataFrame | None) -> DataFrame:
        """Old rows whose key is not replaced, and the new rows with their audit columns."""
        stamped = self._stamped(new, as_of)
        if "created_at" in self.stamps:
            born = old.select(self.key, F.col("created_at").alias("_born"))
            kept = F.coalesce("_born", "created_at")
            stamped = stamped.join(born, self.key, "left").withColumn("created_at", kept).drop("_born")
        keys = new.select(self.key)
        if replacing is not None:
            keys = keys.unionByName(replacing.select(self.key))
        return old.join(keys, self.key, "left_anti").unionByName(stamped)

    def _exists(self, path: str) -> bool:
        hadoop, _, fs = self._fs()
        return fs.exists(hadoop.Path(path))
