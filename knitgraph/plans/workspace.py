"""Staged tables that cut the lineage of iterative jobs.

A loop that only chains DataFrames grows its logical plan every round. Each
round is therefore written as Parquet below the shared checkpoint folder and
read back. Against ``DataFrame.checkpoint`` this keeps column pruning and real
size statistics (so the automatic broadcast decision sees true sizes), and a
lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, or else a folder of the
    warehouse, which all executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/knitgraph-staging"


@dataclass(frozen=True)
class Staged:
    """A written table, its row count and the measures taken while writing it."""

    df: DataFrame
    path: str
    rows: int
    measures: dict[str, int]


class Workspace:
    """The folder that holds the staged tables of one operator run.

    It lives until it is closed (it is a context manager) or the session ends. One with a ``run`` name can
    be opened again by a later driver: it keeps a note of each step, from which loops go on, and stays until it is closed.
    """

    def __init__(self, spark: SparkSession, label: str, run: str | None = None):
        self.spark = spark
        self.run = run
        self.path = f"{checkpoint_root(spark)}/knitgraph-{label}-{run or uuid.uuid4().hex}"
        self._saved = 0
        self._tables: dict[str, str] = {}  # names of bucketed tables by path
        folder, files = self._located(self.path)
        files.mkdirs(folder)
        if run is None:
            # Tables that back a returned result live as long as the session, not longer.
            files.deleteOnExit(folder)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *raised) -> None:
        self.close()

    def _located(self, path: str):
        """A Hadoop path and its file system."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop = self.spark._jsparkSession.sessionState().newHadoopConf()
        return found, found.getFileSystem(hadoop)

    def next_path(self, name: str) -> str:
        self._saved += 1
        # A run that goes on must not meet what its first driver left unfinished.
        again = f"-{uuid.uuid4().hex[:8]}" if self.run else ""
        return f"{self.path}/{self._saved:04d}-{name}{again}"

    def save(
        self,
        df: DataFrame,
        name: str,
        **measures: Column,
    ) -> Staged:
        """Write ``df`` and measure it in the same job.

        The observation sits directly below the writer, hence in the result
        stage, where a retried task is counted once.
        """
        path = self.next_path(name)
        taken = self._written(df, name, path, None, measures)
        # The schema is known: giving it saves the job that would infer it.
        return Staged(
            df=self.spark.read.schema(df.schema).parquet(path),
            path=path,
            rows=taken.pop("rows"),
            measures=taken,
        )

    def _written(
        self, df: DataFrame, name: str, path: str, partition_by: list[str] | None, measures: dict[str, Column],
        table: tuple[str, int, str] | None = None,
    ) -> dict:
        observation = Observation(f"{name}-{uuid.uuid4().hex}")
        observed = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            *[measure.alias(key) for key, measure in measures.items()],
        )
        writer = observed.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        # What is written is read again from there: the shuffle files of the job that wrote it can go at once, and need not
        # wait for the driver to forget the plan.
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            if table:
                called, buckets, column = table
                writer.bucketBy(buckets, column).format("parquet").option("path", path).saveAsTable(called)
            else:
                writer.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return {key: value or 0 for key, value in observation.get.items()}

    def save_bucketed(self, df: DataFrame, name: str, folder: str, **measures: Column) -> Staged:
        """Write ``df`` in folders by a column, which comes last."""
        path = self.next_path(name)
        ordered = df.select(*[c for c in df.columns if c != folder], folder)
        taken = self._written(ordered, name, path, [folder], measures)
        found, files = self._located(path)
        files.mkdirs(found)
        return Staged(self.spark.read.schema(ordered.schema).parquet(path), path, taken.pop("rows"), taken)

    def save_dealt(self, df: DataFrame, name: str, column: str, buckets: int, **measures: Column) -> Staged:
        """Write ``df`` as a table in buckets by a column: grouped or joined by it, it is not shuffled again."""
        path = self.next_path(name)
        called = f"{self._tag()}_{uuid.uuid4().hex}"
        taken = self._written(df, name, path, None, measures, (called, buckets, column))
        self._tables[path] = called
        return Staged(self.spark.table(called), path, taken.pop("rows"), taken)

    def save_split(
        self, df: DataFrame, name: str, flag: str, off_schema: StructType, folder: str | None = None
    ) -> tuple[Staged, Staged]:
        """Write ``df`` once, in two tables by a boolean column: the rows where it is false, with the columns of
        ``off_schema``, and those where it is true; both in folders by another column, if one is given."""
        path = self.next_path(name)
        if folder:
            df = df.select(*[c for c in df.columns if c != folder], folder)
        taken = self._written(df, name, path, [flag, folder] if folder else [flag], {"on": F.count_if(flag)})
        parts = []
        for value, schema, rows in (
            ("false", off_schema, taken["rows"] - taken["on"]),
            ("true", df.drop(flag).schema, taken["on"]),
        ):
            part = f"{path}/{flag}={value}"
            folder, files = self._located(part)
            files.mkdirs(folder)  # a part without rows is an empty table
            parts.append(Staged(self.spark.read.schema(schema).parquet(part), part, rows, {}))
        return parts[0], parts[1]

    # --- notes of a run that can go on ---

    def note(self, step: str, state: dict) -> None:
        """Keep ``state`` (JSON; staged tables by :meth:`described`) as the newest of ``step``."""
        if self.run is None:
            return
        final, files = self._located(f"{self.path}/notes/{step}/{self._noted(step) + 1:06d}.json")
        written, _ = self._located(f"{self.path}/notes/{step}/.new")
        out = files.create(written, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files.rename(written, final)  # a note is there as a whole or not at all

    def noted(self, step: str) -> dict | None:
        """The newest state of ``step``, or None."""
        number = self._noted(step) if self.run else 0
        if not number:
            return None
        found, files = self._located(f"{self.path}/notes/{step}/{number:06d}.json")
        source = files.open(found)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        return json.loads(text)

    def _noted(self, step: str) -> int:
        folder, files = self._located(f"{self.path}/notes/{step}")
        if not files.exists(folder):
            return 0
        names = [str(status.getPath().getName()) for status in files.listStatus(folder)]
        return max([int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith(".")], default=0)

    @staticmethod
    def described(table: Staged) -> dict:
        return {"path": table.path, "rows": table.rows, "measures": table.measures, "schema": table.df.schema.json()}

    def found(self, description: dict) -> Staged:
        """The staged table of a description."""
        schema = StructType.fromJson(json.loads(description["schema"]))
        df = self.spark.read.schema(schema).parquet(description["path"])
        return Staged(df, description["path"], description["rows"], description["measures"])

    def once(self, step: str, build: Callable[[], Staged]) -> Staged:
        """The table of a step: as an earlier driver of this run left it, or built now."""
        if done := self.noted(step):
            return self.found(done)
        table = build()
        self.note(step, self.described(table))
        return table

    def read(self, *tables: Staged) -> DataFrame:
        """The rows of several tables of one schema, in a single scan."""
        paths = [table.path for table in tables]
        return self.spark.read.schema(tables[0].df.schema).parquet(*paths)

    def drop(self, *tables: Staged | None) -> None:
        """Delete staged tables that no returned DataFrame reads any more."""
        for table in tables:
            if table is not None:
                self._forget(table.path)
                path, files = self._located(table.path)
                files.delete(path, True)

    def _forget(self, path: str) -> None:
        """Take a bucketed table out of the catalog, which leaves its files."""
        if called := self._tables.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {called}")

    def _tag(self) -> str:
        """What the names of the bucketed tables of this folder begin with, whichever driver of a run saved them."""
        return f"knitgraph_{zlib.crc32(self.path.encode()):08x}"

    def as_files(self, table: Staged, *columns: str) -> Staged:
        """Columns of a bucketed table, which from now on is no more than its files."""
        self._forget(table.path)
        df = self.spark.read.schema(table.df.select(*columns).schema).parquet(table.path)
        return Staged(df, table.path, table.rows, table.measures)

    def close(self) -> None:
        """Delete the whole folder: no returned DataFrame reads it."""
        for table in list(self._tables):
            self._forget(table)
        if self.run:
            # Those of a driver that was lost in this session.
            for table in self.spark.catalog.listTables("default", f"{self._tag()}_*"):
                self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        path, files = self._located(self.path)
        files.delete(path, True)


@contextmanager
def workspace(spark: SparkSession, label: str, work: Workspace | None = None) -> Iterator[Workspace]:
    """``work``, or a new workspace whose tables are deleted if the block fails."""
    if work is not None:
        yield work
        return
    own = Workspace(spark, label)
    try:
        yield own
    except BaseException:
        own.close()
        raise
