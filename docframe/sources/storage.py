"""Files in any store that Spark reads, by way of Hadoop's file systems; and the folder that a cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of a Hadoop file system, named by any path or URI."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, text: str) -> bool:
        """Makes file ``name`` with ``text``; false if there is one. Others see all of it or nothing.

        Only one of several callers gets true where the store's rename refuses an existing target in one step, as HDFS does.
        """
        made = f"_tmp/{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(made), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = self._fs.makeQualified(self._at(made))
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self._conf).rename(qualified, self._fs.makeQualified(self._at(name)), options)
        except Py4JJavaError as error:
            self._fs.delete(self._at(made), False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, name: str = "") -> dict[str, int]:
        """What lies directly below: names and when they were changed, in milliseconds; none if there is no such folder."""
        if not self.exists(name):
            return {}
        return {s.getPath().getName(): int(s.getModificationTime()) for s in self._fs.listStatus(self._at(name))}

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._at(name)))

    def matches(self, pattern: str) -> bool:
        """Whether a path below, with wildcards, names anything."""
        found = self._fs.globStatus(self._at(pattern))
        return found is not None and len(found) > 0

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a private one only on one machine.

    Raises RuntimeError on a cluster that names none, since other machines would not see a local folder.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="docframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")
