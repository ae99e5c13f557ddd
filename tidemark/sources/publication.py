"""A publication log: tables are staged together, audited, and made visible by one pointer file.

A published set is a small JSON file, numbered, that names for each table the folders of its key buckets. A load stages new
folders for the buckets that it touches and carries all others over as they are, so that a small delta rewrites a small part
and no file that a reader may be reading is ever changed. The pointer file appears by a rename that never replaces another:
readers see the whole old set or the whole new one, a load that fails at any step leaves nothing visible, and of two
loads that started from one set the second one to publish is refused.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import ContractError
from . import sinks
from .scratch import written

#: Buckets of a table unless told otherwise; a pointer file names as many folders a table at most.
BUCKETS = 32


class _Files:
    """The file system of a path, through Spark's own: the store needs to be reachable by nothing else."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(root).toUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def listed(self, folder: str) -> list[tuple[str, int, bool]]:
        """(name, time of change in ms, whether a folder) of what is in a folder; nothing if there is none."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime(), s.isDirectory()) for s in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file with all its text at once; False if there is one of that name already."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(folder))
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            self.context.rename(self.path(part), self.path(name), options)
        except Exception:
            self.fs.delete(self.path(part), False)
            if self.fs.exists(self.path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Entry:
    """A table of a published set: its schema, the columns that choose a row's bucket, and each bucket's folder; ``inputs`` is what it was built from."""

    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str]
    inputs: dict[str, str] = field(default_factory=dict)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass
class Snapshot:
    """A published set. All its tables belong together, whatever is published later."""

    spark: SparkSession
    root: str
    number: int
    entries: dict[str, Entry]
    note: str = ""

    def entry(self, table: str) -> Entry:
        if table not in self.entries:
            raise ContractError("unknown_table", f"{table} in set {self.number}")
        return self.entries[table]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        entry = self.entry(table)
        schema = StructType.fromJson(json.loads(entry.schema))
        paths = [f"{self.root}/{p}" for b, p in sorted(entry.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def buckets(self, table: str, values: DataFrame) -> list[int]:
        """The buckets that the keys in ``values`` fall into: at most as many as the table has."""
        entry = self.entry(table)
        return sorted(r["b"] for r in values.select(bucket_of(entry.keys, entry.buckets).alias("b")).distinct().collect())

    def fingerprint(self, table: str, buckets: list[int] | None = None) -> str:
        """Changes when, and only when, the table (or any of these buckets) was written anew."""
        entry = self.entry(table)
        named = sorted((b, p) for b, p in entry.folders.items() if buckets is None or int(b) in buckets)
        return sha256(json.dumps(named).encode()).hexdigest()[:16]


class Log:
    """The sets published under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for name, _, _ in self.files.listed(f"{self.root}/_log") if (m := re.fullmatch(r"(\d+)\.json", name)))

    def at(self, number: int) -> Snapshot:
        if number == 0:
            return Snapshot(self.spark, self.root, 0, {})
        text = json.loads(self.files.read(f"{self.root}/_log/{number:012d}.json"))
        return Snapshot(self.spark, self.root, number, {t: Entry(**e) for t, e in text["tables"].items()}, text["note"])

    def latest(self) -> Snapshot:
        """What readers see: the last published set, or an empty one."""
        return self.at(max(self.numbers(), default=0))

    def begin(self, note: str = "") -> "Load":
        return Load(self, self.latest(), note)

    def vacuum(self, keep: int = 2, older_than: float = 7 * 86400) -> int:
        """Delete staged folders that none of the last ``keep`` sets names and that are ``older_than`` seconds old; returns how many.

        The age protects loads that are still staging: it must exceed the longest load, and ``keep`` the longest read.
        """
        kept = {p.rpartition("/")[0] for n in self.numbers()[-keep:] for e in self.at(n).entries.values() for p in e.folders.values()}
        gone = 0
        for table, _, is_folder in self.files.listed(f"{self.root}/tables"):
            for name, at, _ in self.files.listed(f"{self.root}/tables/{table}") if is_folder else []:
                if f"tables/{table}/{name}" not in kept and at < (time.time() - older_than) * 1000:
                    self.files.delete(f"{self.root}/tables/{table}/{name}")
                    gone += 1
        return gone


class Load:
    """Changes to a published set in the making: ``with log.begin() as load`` publishes them if all went well, and none if not."""

    def __init__(self, log: Log, base: Snapshot, note: str):
        self.log, self.base, self.note = log, base, note
        self.now = Snapshot(log.spark, log.root, base.number, dict(base.entries), note)
        self.made: list[str] = []
        self.changed_buckets: dict[str, list[int]] = {}
        self.published: Snapshot | None = None

    def __enter__(self) -> "Load":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.publish()
        else:
            self.discard()

    def read(self, table: str) -> DataFrame:
        """The table as it will be."""
        return self.now.read(table)

    def changed(self, table: str) -> DataFrame:
        """The rows of the buckets that this load has staged."""
        return self.now.read(table, self.changed_buckets.get(table, []))

    def _stage(self, table: str, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Write rows by bucket into a new folder. Rebalancing splits a bucket that one key fills over several tasks and files."""
        folder = f"tables/{table}/v-{uuid.uuid4().hex}"
        self.made.append(folder)
        rows.withColumn("_bucket", bucket_of(keys, buckets)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.log.root}/{folder}")
        found = (re.fullmatch(r"_bucket=(\d+)", name) for name, _, _ in self.log.files.listed(f"{self.log.root}/{folder}"))
        return {m[1]: f"{folder}/{m[0]}" for m in found if m}

    def write(self, table: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS, inputs: dict[str, str] | None = None) -> None:
        """The whole table anew, in buckets by ``keys``."""
        folders = self._stage(table, rows, keys, buckets)
        self.now.entries[table] = Entry(rows.schema.json(), keys, buckets, folders, inputs or {})
        self.changed_buckets[table] = [int(b) for b in folders]

    def _rewrite(self, table: str, touched: list[int], rows: DataFrame) -> None:
        entry = self.now.entry(table)
        folders = {b: p for b, p in entry.folders.items() if int(b) not in touched}
        if touched:
            folders |= self._stage(table, rows.select(*StructType.fromJson(json.loads(entry.schema)).names), entry.keys, entry.buckets)
        self.now.entries[table] = Entry(entry.schema, entry.keys, entry.buckets, folders, entry.inputs)
        self.changed_buckets[table] = sorted({*self.changed_buckets.get(table, []), *touched})

    def merge(self, table: str, delta: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Put the rows of ``delta`` in place of those with their key; of several the one with the largest ``order``.

        Only buckets that ``delta`` has rows for are read and written. ``keys`` must hold the columns that choose the bucket.
        Columns that only ``delta`` has, such as ``order``, are not kept.
        """
        entry = self.now.entry(table)
        if not set(entry.keys) <= set(keys):
            raise ContractError("bad_keys", f"{table} is in buckets by {entry.keys}, which {keys} does not hold")
        delta = written(delta, "delta")
        touched = self.now.buckets(table, delta)
        self._rewrite(table, touched, sinks.merge_last(self.now.read(table, touched), delta, keys, order))

    def replace(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Put ``rows`` in place of all rows with any of their bucket keys, and take away those with the keys of ``gone``."""
        entry = self.now.entry(table)
        rows = written(rows, "rows")
        ids = rows.select(*entry.keys) if gone is None else rows.select(*entry.keys).unionByName(gone.select(*entry.keys))
        ids = written(ids.distinct(), "keys")
        touched = self.now.buckets(table, ids)
        names = StructType.fromJson(json.loads(entry.schema)).names
        old = self.now.read(table, touched).join(ids, entry.keys, "left_anti")
        self._rewrite(table, touched, old.select(*names).unionByName(rows.select(*names)))

    def audit(self, table: str, violations: Callable[[DataFrame], DataFrame]) -> None:
        """Run a contract, (rule, n_rows) of rows, on what was staged; a broken rule stops the load before anything shows."""
        bad = [f"{r['rule']}={r['n_rows']}" for r in violations(self.changed(table)).where("n_rows > 0").collect()]  # a row for each rule
        if bad:
            raise ContractError("contract_violated", f"{table}: {', '.join(sorted(bad))}")

    def publish(self) -> Snapshot:
        """Make the staged set visible; refused if another one was published meanwhile. A load without changes leaves the set as it is."""
        if not self.changed_buckets:
            self.published = self.base
            return self.base
        number = self.base.number + 1
        text = json.dumps({"parent": self.base.number, "note": self.note, "tables": {t: asdict(e) for t, e in self.now.entries.items()}})
        if self.log.numbers()[-1:] not in ([], [self.base.number]) or not self.log.files.create(f"{self.log.root}/_log/{number:012d}.json", text):
            self.discard()
            raise ContractError("conflict", f"set {number} was published meanwhile")
        self.published = self.log.at(number)
        return self.published

    def discard(self) -> None:
        """Delete what was staged; a load that dies before this leaves folders that no set names, which ``vacuum`` deletes."""
        for folder in self.made:
            self.log.files.delete(f"{self.log.root}/{folder}")
        self.made = []
