"""A data set: named Parquet tables in one folder; each table is a list of parts that a numbered manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that merges append before they are written together.
MOST_PARTS = 32


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the data sets below ``root``: folders that hold a table with a manifest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*/current-*.json")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted({f.getPath().getParent().getParent().getName() for f in found})


class Dataset:
    """Tables of one work session.

    A write adds files and then the next manifest, so readers see whole tables, a job that dies changes nothing, and of
    two writers that started from the same manifest the second raises. A merge appends only its new rows.
    """

    TABLES = ("documents", "doc_form", "doc_ngram", "whitelist", "whitelist_master", "cooc", "postings", "graph_nodes", "graph_edges", "archive")

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.folder = spark, name, f"{root.rstrip('/')}/{name}"

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, table: str) -> tuple[int, list[str], str | None]:
        """The number of the last manifest, 0 if there is none, the parts it names and their schema."""
        p, fs = self._path(f"{self.folder}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        last = max((int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json")), default=0)
        if not last:
            return 0, [], None
        told = self.spark.read.text(f"{self.folder}/{table}/current-{last}.json", wholetext=True).first()[0]
        told = json.loads(told)
        return last, told["parts"], told["schema"]

    def exists(self, table: str) -> bool:
        return self._current(table)[0] > 0

    def tables(self) -> list[str]:
        return [t for t in self.TABLES if self.exists(t)]

    def read(self, table: str) -> DataFrame:
        number, parts, schema = self._current(table)
        if not number:
            raise ValueError(f"data set {self.name} has no table {table}")
        # The schema is given, as that of folder names would be guessed.
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.folder}/{table}/{v}" for v in parts))

    def _add(self, table: str, df: DataFrame, number: int, parts: list[str], partition_by: str | None = None) -> DataFrame:
        """Write a part and, as the next manifest after ``number``, the list that ends in it."""
        version = uuid.uuid4().hex
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.folder}/{table}/{version}")
        (draft, fs), (path, _) = self._path(f"{self.folder}/{table}/_draft-{version}"), self._path(f"{self.folder}/{table}/current-{number + 1}.json")
        out = fs.create(draft, False)
        out.write(json.dumps({"parts": [*parts, version], "schema": df.schema.json()}).encode())
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has changed {self.folder}/{table}; try again")
        return self.read(table)

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        return self._add(table, df, self._current(table)[0], [], partition_by)

    def merge(self, table: str, new: DataFrame, keys: list[str]) -> DataFrame:
        """Insert rows whose keys aren't there; the stored ones stay as they are, and only their keys are read."""
        number, parts, _ = self._current(table)
        fresh = new.dropDuplicates(keys)
        if not number:
            return self.write(table, fresh)
        stored = self.read(table)
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        if len(parts) >= MOST_PARTS:
            return self._add(table, stored.unionByName(fresh, allowMissingColumns=True), number, [])
        # Parts have the same columns, so that any of them tells the table's.
        kinds = dict(stored.dtypes)
        return self._add(table, fresh.select(*(F.col(f"`{c}`").cast(k) if c in fresh.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items())), number, parts)

    def upsert(self, table: str, new: DataFrame, keys: list[str]) -> DataFrame:
        """Rows that replace stored ones of the same keys, or are new."""
        number = self._current(table)[0]
        fresh = new.dropDuplicates(keys)
        if number:
            fresh = self.read(table).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
        return self._add(table, fresh, number, [])

    def load(self, table: str, key: str, value) -> DataFrame:
        return self.read(table).where(F.col(key) == value)

    def delete(self, table: str, key: str, value) -> DataFrame:
        return self.write(table, self.read(table).where(F.col(key) != value))

    def clean(self, table: str) -> None:
        """Delete parts and manifests that the last manifest doesn't name; readers of older ones must be done."""
        number, parts, _ = self._current(table)
        p, fs = self._path(f"{self.folder}/{table}")
        for f in fs.listStatus(p) if number else []:
            if f.getPath().getName() not in {*parts, f"current-{number}.json"}:
                fs.delete(f.getPath(), True)

    def drop(self) -> None:
        p, fs = self._path(self.folder)
        fs.delete(p, True)
