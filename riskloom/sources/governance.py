"""A versioned registry of governance verdicts with atomic commits.

Rows of a commit are written first, to a folder that nobody reads yet. A small
numbered file then names that folder; it is renamed into place without
overwriting, so of two writers that read the same state one gets the next
number and the other a ``Conflict``. Readers see committed rows only, and a
writer lost half-way leaves no trace in them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.drift import governance_audit
from riskloom.sources.store import FeatureView

VERDICT_SCHEMA = """view string, version string, feature string, null_ratio double, variance double, psi double,
    status string, tag string, entry string"""
COMMIT_SCHEMA = "commit long, entry string, path string"


class Conflict(RuntimeError):
    """Another writer committed first; read again and retry."""


def view_verdicts(train: DataFrame, test: DataFrame, view: FeatureView) -> DataFrame:
    """Null share, variance and PSI of every feature of ``view``, with the verdict."""
    found = governance_audit(train, test, list(view.features))
    return found.select(F.lit(view.name).alias("view"), F.lit(view.version).alias("version"), "feature", "null_ratio", "variance", "psi", "status", "tag")


class VerdictRegistry:
    """Verdicts below ``base``, a folder that every writer and reader shares."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        path = self._fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self._conf).makeQualified(path)

    def commits(self) -> DataFrame:
        """``(commit, entry, path)``: one row per commit."""
        folder = self._path("commits")
        if not folder.getFileSystem(self._conf).exists(folder):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(folder.toString())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        return self.commits().agg(F.max("commit").alias("n")).first()["n"] or 0

    def commit(self, verdicts: DataFrame, expected: int) -> int:
        """Add ``verdicts`` as commit ``expected + 1``, or raise ``Conflict`` if that number is taken."""
        entry, number = uuid.uuid4().hex, expected + 1
        rows = self._path(f"entries/{entry}")
        verdicts.withColumn("entry", F.lit(entry)).write.parquet(rows.toString())
        staged, target = self._path(f"staging/{entry}"), self._path(f"commits/{number:020d}.json")
        fs = staged.getFileSystem(self._conf)
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({"commit": number, "entry": entry, "path": rows.toString()}).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        kind = getattr(self._fs, "Options$Rename")
        once = self.spark._sc._gateway.new_array(kind, 1)
        once[0] = kind.NONE
        try:
            self._fs.FileContext.getFileContext(target.toUri(), self._conf).rename(staged, target, once)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.toString():
                raise
            raise Conflict(f"commit {number} is taken") from error
        return number

    def publish(self, verdicts: DataFrame, attempts: int = 10) -> int:
        """Commit on top of whatever is newest, again after a conflict."""
        for _ in range(attempts):
            try:
                return self.commit(verdicts, self.version())
            except Conflict:
                continue
        raise Conflict(f"no free number in {attempts} attempts")

    def history(self) -> DataFrame:
        """The verdicts of all commits with their ``commit``."""
        commits = self.commits()
        paths = [r["path"] for r in commits.select("path").collect()]
        rows = self.spark.read.schema(VERDICT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], VERDICT_SCHEMA)
        return rows.join(commits.select("entry", "commit"), "entry").drop("entry")

    def current(self) -> DataFrame:
        """The newest verdicts of each view."""
        history = self.history()
        newest = history.groupBy("view").agg(F.max("commit").alias("commit"))
        return history.join(newest, ["view", "commit"], "left_semi")

    def rejected(self) -> DataFrame:
        """``(view, version, features)`` of views with a failed feature now."""
        failed = self.current().filter(F.col("status") == "FAIL")
        return failed.groupBy("view", "version").agg(F.array_sort(F.collect_set("feature")).alias("features"))
