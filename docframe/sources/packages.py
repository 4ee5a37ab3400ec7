"""Result packages: zip archives with names in order, built one a job and written by Spark."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the earliest time a zip entry can have; equal contents then give equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)


def zip_bytes(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, files[name])
    return out.getvalue()


def build_packages(files: DataFrame) -> DataFrame:
    """(job_id, package, size_bytes, sha256) from (job_id, path, content); a job's files are few and meet in one row."""
    one = F.map_from_entries(F.collect_list(F.struct("path", "content")))
    grouped = files.groupBy("job_id").agg(one.alias("files"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"job_id": frame["job_id"], "package": [zip_bytes({k: bytes(v) for k, v in dict(f).items()}) for f in frame["files"]]})

    built = grouped.mapInPandas(run, f"job_id {dict(files.dtypes)['job_id']}, package binary")
    return built.select("job_id", "package", F.octet_length("package").cast("long").alias("size_bytes"), F.sha2("package", 256).alias("sha256"))


def publish(packages: DataFrame, path: str, attempt: str) -> str:
    """Writes a batch under its attempt's own folder; a repeated attempt replaces only itself."""
    target = f"{path}/_attempt={attempt}"
    packages.write.mode("overwrite").parquet(target)
    return target


def json_text(value: object) -> bytes:
    """JSON as files hold it: UTF-8, indented by two."""
    return json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()


def result_files(jobs: DataFrame) -> DataFrame:
    """(job_id, path, content) of content.md, manifest.json, artifacts.json and visual results.

    ``jobs`` holds (job_id, markdown, manifest string or null, artifacts string or null, visuals map<digest, JSON> or null);
    manifest and artifacts are JSON texts, as of ``to_json``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                rows.append((row.job_id, "content.md", (row.markdown or "").encode()))
                for name, value in (("manifest.json", row.manifest), ("artifacts.json", row.artifacts)):
                    if value is not None:
                        rows.append((row.job_id, name, json_text(json.loads(value))))
                rows += [(row.job_id, f"visual/{digest}.json", json_text(json.loads(v))) for digest, v in sorted(dict(row.visuals or {}).items())]
            yield pd.DataFrame(rows, columns=["job_id", "path", "content"])

    kind = dict(jobs.dtypes)["job_id"]
    return jobs.select("job_id", "markdown", "manifest", "artifacts", "visuals").mapInPandas(run, f"job_id {kind}, path string, content binary")


def stage(files: DataFrame, root: str, attempt: str) -> str:
    """Writes (job_id, path, content) under an attempt's prefix and then, as the last step, the descriptor that lists them."""
    target = f"{root}/_attempt={attempt}"
    files.write.mode("overwrite").parquet(f"{target}/files")
    written = files.sparkSession.read.parquet(f"{target}/files")
    written.select("job_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes")).write.mode("overwrite").parquet(f"{target}/descriptor")
    return target


def load_staged(spark: SparkSession, target: str) -> DataFrame:
    """(job_id, path, content, error) of a staged package by its descriptor: files that are missing or differ have an error."""
    listed = spark.read.parquet(f"{target}/descriptor").withColumnsRenamed({"job_id": "_j", "path": "_p"})
    files = spark.read.parquet(f"{target}/files")
    both = listed.join(files, (F.col("_j") == F.col("job_id")) & (F.col("_p") == F.col("path")), "left")
    same = F.sha2("content", 256) == F.col("sha256")
    error = F.when(F.col("content").isNull(), "package_file_missing").when(~same, "package_file_changed")
    return both.select(F.col("_j").alias("job_id"), F.col("_p").alias("path"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def visual_files(pictures: DataFrame) -> DataFrame:
    """(job_id, path, content) of pictures (job_id, digest, media_type, content): one file for each digest of a job."""
    suffix = F.when(F.lower("media_type").isin("image/jpeg", "image/jpg"), ".jpg").otherwise(".png")
    named = pictures.filter("content is not null").select("job_id", F.concat(F.lit("images/visual/"), F.col("digest"), suffix).alias("path"), "content")
    return named.groupBy("job_id", "path").agg(F.min("content").alias("content"))


def deleted(jobs: DataFrame, root: str) -> DataFrame:
    """Deletes the folders ``root/<job_id>`` of ``jobs``; returns (job_id, files, deleted_bytes). Folders that are gone count as 0.

    The tasks delete, each its jobs', in any store that ``pyarrow.fs`` opens; done again after a failure, it deletes what is left.
    Ids that would leave the root are refused. The result must be written to have effect.
    """
    from pyarrow import fs

    kind = dict(jobs.dtypes)["job_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for frame in frames:
            rows = []
            for job in frame["job_id"]:
                if str(job) in ("", ".", "..") or "/" in str(job):
                    raise ValueError(f"no folder can be named after job {job!r}")
                folder = f"{base.rstrip('/')}/{job}"
                found = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)
                rows.append((job, len(found), sum(f.size for f in found)))
            yield pd.DataFrame(rows, columns=["job_id", "files", "deleted_bytes"])

    return jobs.select("job_id").distinct().mapInPandas(run, f"job_id {kind}, files long, deleted_bytes long")
