"""Versioned tables with an ordered log, and schema migrations over them."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from quillspark.session import delete_path, path_exists, put_if_absent

ENTRY = "version int, ids array<string>, path string, applied_at string"


@dataclass(frozen=True)
class Migration:
    """A step of a schema: from the table as it is (None at first) to the table as it shall be. Steps apply in order of their ids."""

    id: str
    step: Callable[[DataFrame | None], DataFrame]


class VersionedTable:
    """A table as a chain of whole versions.

    A version is a folder of its own with a name that no other writer has, and counts from the moment when its entry of the
    log is there. An entry is put only if no other has its number, so of two writers of one version one succeeds and
    the other is told; readers see the version before or the version after, never a half.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list[Row]:
        """The log in order; one row a version."""
        if not path_exists(self.spark, f"{self.root}/_log"):
            return []
        return self.spark.read.schema(ENTRY).json(f"{self.root}/_log").orderBy("version").collect()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the last one by default; None before the first."""
        found = [e for e in self.entries() if version is None or e.version == version]
        if not found and version is not None:
            raise ValueError(f"no version {version}")
        return self.spark.read.parquet(f"{self.root}/{found[-1].path}") if found else None

    def commit(self, df: DataFrame, ids: Sequence[str], after: int) -> bool:
        """Write the version behind ``after``; False, and nothing left behind, if another writer was first."""
        path = f"data/{after + 1:06d}-{uuid.uuid4().hex[:12]}"
        try:
            df.write.parquet(f"{self.root}/{path}")
            now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            entry = {"version": after + 1, "ids": list(ids), "path": path, "applied_at": now}
            if put_if_absent(self.spark, f"{self.root}/_log/{after + 1:06d}.json", json.dumps(entry) + "\n"):
                return True
        except BaseException:
            delete_path(self.spark, f"{self.root}/{path}")
            raise
        delete_path(self.spark, f"{self.root}/{path}")
        return False

    def vacuum(self, keep: int = 1) -> None:
        """Delete the data of all but the last ``keep`` versions; their entries stay."""
        entries = self.entries()
        for path in {e.path for e in entries[: max(0, len(entries) - keep)]} - {e.path for e in entries[-keep:]}:
            delete_path(self.spark, f"{self.root}/{path}")


def migrate(table: VersionedTable, migrations: Sequence[Migration], *, together: bool = False) -> list[str]:
    """Apply the migrations that the table's own log lacks, in order of their ids; the ids that this call applied.

    Each is one version: its data and its entry appear together or not at all, and what came before a failing one stays. What is
    pending is read again after every lost race, so of two callers each step is applied once. A second run changes
    nothing. With ``together`` all pending steps are one plan and one version, so a large table is written
    once; then a failing step leaves the table as it was.
    """
    order = sorted(migrations, key=lambda m: m.id)
    if len({m.id for m in order}) < len(order):
        raise ValueError("an id stands for two migrations")
    applied: list[str] = []
    while True:
        entries = table.entries()
        known = {i for e in entries for i in e.ids}
        pending = [m for m in order if m.id not in known]
        if not pending:
            return applied
        df = table.read()
        now = pending if together else pending[:1]
        for m in now:
            df = m.step(df)
        if table.commit(df, [m.id for m in now], entries[-1].version if entries else 0):
            applied += [m.id for m in now]
