"""Several tables that change together: appended batches, and a log that says which of them count.

A transaction writes its rows of every table into folders of its own and then one log record, which must have the next
number. That record is all that others see of it: readers take the batches that the log names, so a writer that dies
leaves rows that no reader meets, and of two writers with the same number one is refused, looks at what the other left,
and works its rows out again. This is how rows that depend on what is there (a lease that must still hold, a key that must
be new) are compared and set.

Tables only grow. A row that changes is appended again; ``current`` gives the last one of each key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.sources.storage import Folder

_LOG = "version long, operation string, batch string"
Make = Callable[["Snapshot"], dict[str, DataFrame]]


class Conflict(RuntimeError):
    """Other writers were first too many times."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as they stand after a number of transactions."""

    tables: Tables
    version: int

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table, with ``_version``."""
        return self.tables._read(name, self.version)

    def current(self, name: str, *key: str) -> DataFrame:
        """The last row of each key; a transaction has one row of a key at most."""
        rows = self.read(name)
        rest = [c for c in rows.columns if c not in (*key, "_version")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_version").alias("_r"))
        return last.select(*key, "_r.*")


class Tables:
    """Tables by name, below one folder. ``schemas`` has their columns."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
        self.spark, self.schemas = spark, schemas
        self.folder = Folder(spark, root)

    def version(self) -> int:
        """The number of the last transaction; 0 before the first."""
        return max((int(n.split(".")[0]) for n in self.folder.names("_log") if n.endswith(".json")), default=0)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.version())

    def log(self) -> DataFrame:
        """(version, operation, batch) of every transaction."""
        if not self.folder.exists("_log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).json(f"{self.folder.path}/_log")

    def _read(self, name: str, version: int) -> DataFrame:
        schema = self.schemas[name]
        if not version or not self.folder.exists(name):
            return self.spark.createDataFrame([], f"{schema}, _version long")
        rows = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.folder.path}/{name}").parquet(f"{self.folder.path}/{name}")
        # The batch is the folder's name, so folders that the log doesn't name are not read.
        counted = self.log().filter(F.col("version") <= version).select("batch", F.col("version").alias("_version"))
        return rows.join(counted, "batch").drop("batch")

    def transact(self, operation: str, make: Make, tries: int = 10) -> int:
        """Appends what ``make`` gives for each table, all or nothing, and returns the transaction's number.

        ``operation`` names what is done: if the log has it, nothing is done again, so a caller that doesn't know how its
        last try ended simply tries again. ``make`` must work its rows out from the snapshot that it is given.
        """
        for _ in range(tries):
            now = self.snapshot()
            done = self.log().filter(F.col("operation") == operation).agg(F.min("version")).first()[0]
            if done is not None:
                return done
            batch = uuid.uuid4().hex
            self._write(batch, make(now))
            record = json.dumps({"version": now.version + 1, "operation": operation, "batch": batch})
            if self.folder.create(f"_log/{now.version + 1:020d}.json", record):
                return now.version + 1
            self._drop(batch)
        raise Conflict(operation)

    def _write(self, batch: str, rows: dict[str, DataFrame]) -> None:
        def one(name: str) -> None:
            want = T.StructType.fromDDL(self.schemas[name])
            rows[name].select(*[F.col(f.name).cast(f.dataType) for f in want]).write.parquet(f"{self.folder.path}/{name}/batch={batch}")

        # The tables' jobs run beside each other; the first that fails ends the transaction.
        with ThreadPoolExecutor(max(1, len(rows))) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(one), name) for name in rows]:
                done.result()

    def _drop(self, batch: str) -> None:
        for name in self.schemas:
            self.folder.delete(f"{name}/batch={batch}")

    def sweep(self, older_than_ms: int) -> list[str]:
        """Deletes batches that no record names and that were last written before a time; returns them.

        The time must lie before the start of every transaction that is still under way.
        """
        counted = {f"batch={r[0]}" for r in self.log().select("batch").toLocalIterator()}
        gone = []
        for name in self.schemas:
            for folder, changed in self.folder.names(name).items():
                if folder not in counted and changed < older_than_ms:
                    self.folder.delete(f"{name}/{folder}")
                    gone.append(f"{name}/{folder}")
        return sorted(gone)
