"""SQLite tables as a Spark data source, read in ranges of row numbers.

The file must lie where every executor can open it, for instance on a shared mount.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: declared types of SQLite, by what they contain, and Spark's
KINDS = [("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    """Row numbers ``low`` to below ``high``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high + 1 - low) // self.parts)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"select {', '.join(map(quoted, self.columns))} from {quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))


class SQLite(DataSource):
    """Options: ``path`` of the file, ``table``, and ``parts``, how many ranges are read at once."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        kind = lambda declared: next((k for part, k in KINDS if part in (declared or "").upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema.names, int(self.options.get("parts", 8)))


def table(spark: SparkSession, path: str, name: str, parts: int = 8):
    """A table of an SQLite file; rows added after the last row number was read don't count."""
    spark.dataSource.register(SQLite)
    return spark.read.format("sqlite").option("path", path).option("table", name).option("parts", parts).load()
