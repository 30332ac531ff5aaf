"""Tables that a stream writes exactly once, all of a micro-batch together.

The tables are versions of one log (sources.versions): a micro-batch writes its rows into folders that nobody sees, and one
manifest makes all of them visible together with the number of the micro-batch. A batch that runs again finds its number and
writes nothing; one that died before its manifest left folders that no version has, and writes anew."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sightstream.sources.versions import Versions


class Sink:
    """Tables in a folder, of which each has a schema. One query writes; any number read."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.versions, self.schemas = Versions(spark, path), schemas

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.versions.read(table, self.schemas[table], version)

    def facts(self) -> dict[str, Any]:
        return self.versions.manifest()[1].get("facts", {})

    def has(self, batch: int) -> bool:
        return self.versions.manifest()[1].get("batch", -1) >= batch

    def publish(self, batch: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, facts: dict[str, Any] | None = None) -> bool:
        """Rows that are added to tables, and tables that are replaced, as micro-batch `batch`; False if that is there already."""
        number, manifest = self.versions.manifest()
        if manifest.get("batch", -1) >= batch:
            return False
        tables = dict(manifest["tables"])
        for table, rows in {**added, **(replaced or {})}.items():
            folder = self.versions.write(table, rows)
            tables[table] = [*(tables.get(table, []) if table in added else []), folder]
        done = {**manifest, "tables": tables, "batch": batch, "facts": {**manifest.get("facts", {}), **(facts or {})}}
        if not self.versions.commit(number + 1, done):
            raise RuntimeError(f"another query writes to {self.versions.path}")
        return True

    def compact(self, table: str) -> None:
        """One folder instead of one a micro-batch."""
        number, manifest = self.versions.manifest()
        folder = self.versions.write(table, self.read(table, number))
        if not self.versions.commit(number + 1, {**manifest, "tables": {**manifest["tables"], table: [folder]}}):
            self.versions.remove(table, [folder])
