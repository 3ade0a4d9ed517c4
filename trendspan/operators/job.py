"""A batch of steps as one job: each step writes a table, a ledger says which are done, and a job that broke off goes on where it stopped.

A step's table counts once its entry is in the ledger, which the rename of one small file puts there. A run that is started again under its name reads
the tables of the steps that are in the ledger and works off the others. A step that isn't required may fail without harm to others; its error is in the
report, and a later start tries it again. A required step that fails ends the run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Gives a step's table from the tables of the steps before it.
Work = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    work: Work
    needs: tuple[str, ...] = ()
    required: bool = True


class JobFailed(RuntimeError):
    pass


class Ledger:
    """Entries of one run below a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{run_id}"

    def path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def entry(self, step: str) -> dict | None:
        fs, at = self._fs(), self.path(f"ledger/{step}.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, step: str, entry: dict) -> None:
        """The first entry of a step stays: whoever comes second reads the first one's table."""
        fs, staged, at = self._fs(), self.path(f"ledger/.{uuid.uuid4().hex}"), self.path(f"ledger/{step}.json")
        out = fs.create(staged, False)
        self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.write(json.dumps(entry), out, "UTF-8")
        out.close()
        if fs.exists(at) or not fs.rename(staged, at):
            fs.delete(staged, False)

    def _fs(self):
        return self.path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def run(spark: SparkSession, root: str, run_id: str, steps: list[Step]) -> DataFrame:
    """Work off the steps in order; ``step, status, rows, error`` of each. ``status`` is done, reused, failed or skipped."""
    ledger, tables, report = Ledger(spark, root, run_id), {}, []
    for step in steps:
        missing = [n for n in step.needs if n not in tables]
        if missing:
            report.append((step.name, "skipped", None, f"needs {', '.join(missing)}"))
            continue
        entry, status = ledger.entry(step.name), "reused"
        if entry is None:
            status = "done"
            try:
                table, where = step.work(spark, tables), f"{ledger.root}/{step.name}-{uuid.uuid4().hex[:8]}"
                table.write.parquet(where)
                ledger.commit(step.name, {"path": where, "schema": table.schema.json(), "rows": spark.read.schema(table.schema).parquet(where).count()})
                entry = ledger.entry(step.name)
            except Exception as error:  # noqa: BLE001 - whatever a step breaks on is its own
                if step.required:
                    raise JobFailed(f"{step.name}: {error}") from error
                report.append((step.name, "failed", None, str(error).split("\n")[0]))
                continue
        tables[step.name] = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])
        report.append((step.name, status, entry["rows"], None))
    return spark.createDataFrame(report, "step string, status string, rows long, error string")
