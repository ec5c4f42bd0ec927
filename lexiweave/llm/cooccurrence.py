"""Items that appear together: an incremental pair table.

A basket is a record's set of items. A change of baskets is written once and emits signed deltas (minus for the old
basket, plus for the new one) of pairs, of items and of the number of records. They are summed by key before the
shuffle and merged into counts kept in hash buckets; only touched buckets are written again. The number of buckets
follows the number of rows: a table that outgrows its buckets is spread over more of them by the next merge.
Association scores are recomputed for pairs whose counts, or whose items' counts, changed.

The pairs of a basket are made by two nested explodes, so even a very long basket is never held as a list of pairs.
No count is capped. Each merge writes a new version and then its manifest (the version of each bucket, and of the
totals), so a job that dies leaves the old version whole. A table opened on a folder goes on from its last manifest;
one writer at a time is expected, and ``clean`` removes what no longer belongs to it.

Edge cases: null baskets and items hold nothing but still count as a record; repeated items count once; a pair
whose count falls to zero leaves the table; an empty change leaves the table as it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.store import delete_on_exit, materialise, release, shared_dir

#: Rows of pairs in a bucket, about, and buckets of a table at least.
BUCKET_ROWS = 1_000_000
BUCKETS = 16

_PAIRS, _ITEMS, _TOTALS = "bucket int, field_name string, item_a string, item_b string, n long", "bucket int, field_name string, item string, n long", "field_name string, n long"


def clean_sets(baskets: DataFrame) -> DataFrame:
    """Baskets (field_name, items, sign) with sorted, distinct items, none of them null."""
    return baskets.select("field_name", "sign", F.sort_array(F.array_distinct(F.array_compact("items"))).alias("items"))


def basket_pairs(sets: DataFrame) -> DataFrame:
    """field_name, item_a < item_b, sign for each pair of each basket of ``clean_sets``."""
    left = sets.where(F.size("items") > 1).select("field_name", "sign", "items", F.posexplode("items").alias("p", "item_a"))
    left = left.where(F.col("p") < F.size("items") - 1)
    return left.select("field_name", "sign", "item_a", F.explode(F.expr("slice(items, p + 2, size(items))")).alias("item_b"))


class PairTable:
    """Persistent counts of pairs and items, by version. Without a folder the table goes when the JVM ends."""

    def __init__(self, spark: SparkSession, folder: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.buckets, self.bucket_rows = spark, BUCKETS, bucket_rows
        if not folder:
            folder = f"{shared_dir(spark)}/lexiweave/pairs-{uuid.uuid4().hex}"
            delete_on_exit(spark, folder)
        self.folder = folder
        self.parts: dict[str, dict[int, str]] = {"pairs": {}, "items": {}}
        self.totals_at: str | None = None
        self.merges = 0
        self._open()

    def _path(self, name: str):
        """A path below ``manifests``, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        """Take over what the last manifest of the folder says, if there is one."""
        path, fs = self._path("")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        if done := [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]:
            self.merges = max(done)
            told = json.loads(self.spark.read.text(f"{self.folder}/manifests/{self.merges:012d}.json", wholetext=True).first()[0])
            self.buckets, self.totals_at = told["buckets"], f"{self.folder}/totals/{told['totals']}"
            self.parts = {name: {int(b): version for b, version in own.items()} for name, own in told["parts"].items()}

    def _commit(self, parts: dict[str, dict[int, str]], totals: str, buckets: int) -> None:
        """Write the next manifest under another name and rename it, so that it is there whole or not at all."""
        (draft, fs), (path, _) = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{self.merges + 1:012d}.json")
        out = fs.create(draft, False)
        out.write(json.dumps({"buckets": buckets, "totals": totals, "parts": parts}).encode())
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"another writer has changed {self.folder}; open it again")
        self.merges += 1
        self.buckets, self.parts, self.totals_at = buckets, parts, f"{self.folder}/totals/{totals}"

    def _load(self, name: str, schema: str) -> DataFrame:
        by_version: dict[str, list[int]] = {}
        for bucket, version in self.parts[name].items():
            by_version.setdefault(version, []).append(bucket)
        df = self.spark.createDataFrame([], schema)
        for version, own in by_version.items():
            read = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}")
            df = df.unionByName((read if len(own) == self.buckets else read.where(F.col("bucket").isin(own))).select(df.columns))
        return df

    @property
    def pairs(self) -> DataFrame:
        return self._load("pairs", _PAIRS)

    @property
    def items(self) -> DataFrame:
        return self._load("items", _ITEMS)

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.schema(_TOTALS).parquet(self.totals_at) if self.totals_at else self.spark.createDataFrame([], _TOTALS)

    def _merge(self, name: str, schema: str, keys: list[str], deltas: DataFrame, version: str, buckets: int) -> dict[int, str]:
        """Sum the deltas (keys, n) into the buckets they touch; the versions of all buckets after that.

        The first load reads and compares nothing; where the number of buckets changes, all are written again.
        """
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        deltas = deltas.select(bucket, *keys, "n")
        moved = buckets != self.buckets or not self.parts[name]
        touched = set(range(buckets)) if moved else {r[0] for r in deltas.select("bucket").distinct().collect()}  # at most as many as there are buckets
        if self.parts[name]:
            old = self._load(name, schema)
            old = old.select(bucket, *keys, "n") if moved else old.where(F.col("bucket").isin(sorted(touched & set(self.parts[name]))))
            deltas = deltas.unionByName(old).groupBy("bucket", *keys).agg(F.sum("n").alias("n"))
        if touched:
            deltas.where("n > 0").repartition("bucket").sortWithinPartitions("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}/{version}")
        return ({} if moved else self.parts[name]) | dict.fromkeys(touched, version)

    def apply(self, new: DataFrame, old: DataFrame | None = None, records: DataFrame | None = None) -> None:
        """Merge a change: baskets (field_name, items) that came and, in ``old``, the ones they replace.

        ``records`` (field_name, n) gives the signed change of the number of records where it isn't the number of
        baskets, for instance as records without items were left out.
        """
        version = uuid.uuid4().hex
        change = new.select("field_name", "items", F.lit(1).alias("sign"))
        if old is not None:
            change = change.unionByName(old.select("field_name", "items", F.lit(-1).alias("sign")))
        change = materialise(clean_sets(change))
        summed = lambda rows, keys: rows.groupBy(*keys).agg(F.sum("sign").alias("n")).where("n <> 0")
        by = {"items": ["field_name", "item"], "pairs": ["field_name", "item_a", "item_b"]}
        pairs = materialise(summed(basket_pairs(change), by["pairs"]))
        rows = pairs.count() + (self.pairs.count() if self.parts["pairs"] else 0)
        buckets = self.buckets
        while rows > 2 * buckets * self.bucket_rows:
            buckets *= 2
        items = summed(change.select("field_name", "sign", F.explode("items").alias("item")), by["items"])
        parts = {"items": self._merge("items", _ITEMS, by["items"], items, version, buckets), "pairs": self._merge("pairs", _PAIRS, by["pairs"], pairs, version, buckets)}
        got = records if records is not None else change.groupBy("field_name").agg(F.sum("sign").alias("n"))
        self.totals.unionByName(got.select("field_name", F.col("n").cast("long").alias("n"))).groupBy("field_name").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{self.folder}/totals/{version}")
        self._commit(parts, version, buckets)
        release(pairs)
        release(change)

    def clean(self) -> None:
        """Delete versions and manifests that the current manifest doesn't name; readers of older ones must be done."""
        keep = {name: set(own.values()) for name, own in self.parts.items()} | {"totals": {(self.totals_at or "").rsplit("/", 1)[-1]}, "manifests": {f"{self.merges:012d}.json"}}
        for name, own in keep.items():
            path, fs = self._path(f"../{name}")
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in own:
                    fs.delete(f.getPath(), True)

    def scores(self, touched: DataFrame | None = None, least: int = 1, per: int | None = None) -> DataFrame:
        """Each pair with n_ab, n_a, n_b, n_records and lift (times more often than chance).

        ``touched`` (field_name, item) restricts to pairs with one of these items: after a change, the items of the
        changed baskets are those whose scores moved for another reason than the number of records. ``least`` and
        ``per`` keep pairs with n_ab >= least and per * n_ab >= n_records, before any join of items.
        """
        # One row per field name.
        pairs = self.pairs.withColumnRenamed("n", "n_ab").where(F.col("n_ab") >= least).join(F.broadcast(self.totals.withColumnRenamed("n", "n_records")), "field_name")
        if per:
            pairs = pairs.where(F.col("n_ab") * per >= F.col("n_records"))
        if touched is not None:
            hit = touched.select("field_name", F.col("item").alias("hit")).distinct()
            either = pairs.select("*", F.explode(F.array("item_a", "item_b")).alias("hit")).join(hit, ["field_name", "hit"], "left_semi")
            pairs = either.drop("hit").dropDuplicates(["field_name", "item_a", "item_b"])
        side = lambda x: self.items.select("field_name", F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
        got = pairs.join(side("a"), ["field_name", "item_a"]).join(side("b"), ["field_name", "item_b"])
        lift = F.col("n_records").cast("double") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))
        return got.select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", lift.alias("lift"))


def associated(scores: DataFrame, times: int = 6) -> DataFrame:
    """The pairs that meet at least ``times`` as often as chance, compared in whole numbers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return scores.where(big("n_records") * big("n_ab") >= F.lit(times).cast("decimal(2,0)") * big("n_a") * big("n_b"))
