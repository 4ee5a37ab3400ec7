"""Assembly as a stream: ends of leaves come as they may, and a job's outcome is told once, when the last has come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docframe.durable.assembly import outcome
from docframe.operators.queue import DONE

#: What is told of a leaf: ``kinds`` are those of the whole job.
LEAVES = "job_id string, at timestamp, kind string, status string, result string, code string, message string, kinds array<string>"
_OUT = "job_id string, leaves array<struct<kind:string,status:string,result:string,error:struct<code:string,message:string>>>"


class Ends(StatefulProcessor):
    """The first end of each of a job's leaves; all of them are given once the set is whole, and what comes later is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getMapState("ends", "kind string", "status string, result string, code string, message string")
        self.told = handle.getValueState("told", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.told.exists():
            return
        wanted: set[str] = set()
        for row in sorted(rows, key=lambda r: (r["at"], r["kind"])):
            wanted |= set(row["kinds"])
            if row["status"] in DONE and not self.ends.containsKey((row["kind"],)):
                self.ends.updateValue((row["kind"],), (row["status"], row["result"], row["code"], row["message"]))
        ended = {k[0]: tuple(v) for k, v in self.ends.iterator()} if self.ends.exists() else {}
        if not wanted <= set(ended):
            return
        leaves = [Row(kind=k, status=s, result=r, error=Row(code=c, message=m) if c is not None else None) for k, (s, r, c, m) in sorted(ended.items())]
        self.told.update((True,))
        self.ends.clear()
        yield Row(job_id=key[0], leaves=leaves)

    def close(self) -> None:
        pass


def outcomes(leaves: DataFrame) -> DataFrame:
    """(job_id, branch, outcome, error, warnings) of each job of a stream of LEAVES when its last leaf ends. Needs the RocksDB state store."""
    whole = leaves.groupBy("job_id").transformWithState(Ends(), _OUT, "Append", "None")
    return whole.select("job_id", outcome(F.col("leaves")).alias("o")).select("job_id", "o.*")
