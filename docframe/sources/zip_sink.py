"""Result packages as files: a data source that writes one .zip a job, and reads them back.

Rows (job_id, path, content) of a job must come to one task, together; ``write_packages`` sees to it. A task writes its
archives below a folder of the write's own; only when all tasks have ended well does the driver move them to their places,
so a task that fails or runs twice leaves nothing behind. Many archives are spread over folders, dealt to tasks whole: the
driver then moves folders and hears of no single archive, and tasks list and read a folder each. Any store that ``pyarrow.fs`` opens will do: local, HDFS, S3, GCS.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .packages import EPOCH

FORMAT = "zip_packages"
ENTRIES = "job_id string, path string, content binary"
#: How names of folders begin that archives are spread over.
FOLDER = "jobs-"
#: Bytes of entries that a task gives on at once.
HELD = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """Archives of one task: (temporary path, name, bytes, sha256); where they are spread, only its folders: (temporary path, name)."""

    files: list[tuple[str, str, int, str]] = field(default_factory=list)
    folders: list[tuple[str, str]] = field(default_factory=list)


class _Counted(io.RawIOBase):
    """Passes bytes on, counting and hashing them."""

    def __init__(self, out) -> None:
        self.out, self.size, self.digest = out, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.size += len(data)
        self.digest.update(data)
        return len(data)

    def flush(self) -> None:
        pass


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, spread: bool = False) -> None:
        self.path, self.overwrite, self.spread = path, overwrite, spread
        self.part = f"_temporary/{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.path)
        return store, base.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        store, base = self._store()
        folder = f"{base}/{self.part}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done, job, seen, known = Written(), None, set(), set()
        archive = counted = stream = None

        def close() -> None:
            archive.close()
            stream.close()
            if not self.spread:
                done.files.append((f"{folder}/{job}.zip", f"{job}.zip", counted.size, counted.digest.hexdigest()))

        for row in rows:
            if row["job_id"] is None or "/" in row["job_id"] or row["job_id"] in ("", ".", ".."):
                raise ValueError(f"no file can be named after job {row['job_id']!r}")
            if row["job_id"] != job:
                if archive:
                    close()
                job = row["job_id"]
                if self.spread and (not done.folders or done.folders[-1][1] != row["folder"]):
                    name = row["folder"] or ""
                    if not name.startswith(FOLDER) or "/" in name or name in known:
                        raise ValueError(f"rows of folder {name!r} are apart" if name in known else f"no folder of archives can be named {name!r}")
                    known.add(name)
                    # A job has one folder, so only the jobs of this one can come again.
                    seen.clear()
                    done.folders.append((f"{folder}/{row['folder']}", row["folder"]))
                    store.create_dir(done.folders[-1][0])
                if job in seen:
                    raise ValueError(f"rows of job {job} are apart")
                seen.add(job)
                stream = store.open_output_stream(f"{done.folders[-1][0] if self.spread else folder}/{job}.zip")
                counted = _Counted(stream)
                archive = zipfile.ZipFile(counted, "w", compression=zipfile.ZIP_DEFLATED)
            info = zipfile.ZipInfo(row["path"], EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, bytes(row["content"] or b""))
        if archive:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        if self.overwrite:
            old = fs.FileSelector(base, allow_not_found=True)
            for there in store.get_file_info(old):
                if there.type == fs.FileType.File and there.path.endswith(".zip"):
                    store.delete_file(there.path)
                elif there.type == fs.FileType.Directory and there.base_name.startswith(FOLDER):
                    store.delete_dir(there.path)
        for message in messages:
            for made, name, _, _ in message.files if message else ():
                store.move(made, f"{base}/{name}")
            for made, name in message.folders if message else ():
                self._join(store, made, f"{base}/{name}")
        self._clear(store, base)

    def _join(self, store: fs.FileSystem, made: str, target: str) -> None:
        """Moves a folder; its files one by one where the target is there already or the store moves files only."""
        if store.get_file_info(target).type == fs.FileType.NotFound:
            try:
                store.move(made, target)
                return
            except (OSError, NotImplementedError):
                store.create_dir(target)
        for file in store.get_file_info(fs.FileSelector(made)):
            store.move(file.path, f"{target}/{file.base_name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.part}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.part}")
        left = fs.FileSelector(f"{base}/_temporary", allow_not_found=True)
        if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound and not store.get_file_info(left):
            store.delete_dir(f"{base}/_temporary")


class ZipPackages(DataSource):
    """``df.write.format("zip_packages")``: one archive for each job, entries as they come."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        spread = "folder" in schema.fieldNames()
        if set(schema.fieldNames()) - {"folder"} != {"job_id", "path", "content"}:
            raise ValueError(f"expected {ENTRIES}, and folder string where archives are spread")
        return PackageWriter(self.options["path"], overwrite, spread)


def write_packages(files: DataFrame, path: str, overwrite: bool = False, folders: int | None = None) -> None:
    """An archive below ``path`` for each job of ``files`` (job_id, path, content), entries in order of their names.

    Of rows that repeat a job's path the least content counts. Without ``overwrite``, archives of other jobs stay, and
    equal files give equal bytes, so a write that is done again changes nothing. With ``folders``, archives are spread over
    that many by a hash of the job; there should be one for some hundred jobs, and as many for all writes below a path.
    """
    files.sparkSession.dataSource.register(ZipPackages)
    rows = files.select(F.col("job_id").cast("string").alias("job_id"), "path", "content")
    by = ["folder"] if folders else []
    if folders:
        rows = rows.withColumn("folder", F.format_string(f"{FOLDER}%06d", F.pmod(F.xxhash64("job_id"), F.lit(folders))))
    rows = rows.repartition(*by or ["job_id"])
    # Grouped within the partition of the job or its folder: no other shuffle.
    once = rows.groupBy(*by, "job_id", "path").agg(F.min("content").alias("content")).sortWithinPartitions(*by, "job_id", "path")
    once.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def _folder_entries(path: str):
    """Entries of all archives of a task's folders, in batches of about HELD bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["job_id", "path", "content"])

        for batch in batches:
            for number in batch.column(0).to_pylist():
                for file in store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{FOLDER}{number:06d}", allow_not_found=True)):
                    if not file.base_name.endswith(".zip"):
                        continue
                    with store.open_input_stream(file.path) as stream, zipfile.ZipFile(io.BytesIO(stream.read())) as archive:
                        for name in archive.namelist():
                            rows.append((file.base_name.removesuffix(".zip"), name, archive.read(name)))
                            size += len(rows[-1][2])
                            if size >= HELD:
                                yield out()
                                rows, size = [], 0
        if rows:
            yield out()

    return run


def read_packages(spark: SparkSession, path: str, folders: int | None = None) -> DataFrame:
    """(job_id, path, content) of all archives below ``path``; with ``folders``, of those that were spread over as many."""
    if folders:
        tasks = max(spark.sparkContext.defaultParallelism, -(-folders // 8))
        return spark.range(0, folders, 1, min(folders, tasks)).mapInArrow(_folder_entries(path), ENTRIES)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    job = name.rsplit("/", 1)[-1].removesuffix(".zip")
                    yield pd.DataFrame([(job, x, archive.read(x)) for x in archive.namelist()], columns=["job_id", "path", "content"])

    return archives.mapInPandas(entries, ENTRIES)
