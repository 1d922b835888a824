"""The ledger of exported records: four append-only tables.

Every append goes to the folder of its own batch in overwrite mode, so writing
a batch again after a failure replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright import schema
from setwright.functions.text import hex_to_bytes
from setwright.operators.numbering import dense_ids
from setwright.session import exists

TABLES = {
    "hashes": schema.HASHES,
    "files": schema.FILES,
    "metadata": schema.METADATA,
    "labels": schema.LABELS,
}


def first_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key in ``seq`` order.

    A map-side-combined minimum: copies of one key leave each task as one row.
    """
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in rows.columns])


def new_records(records: DataFrame, ledger_hashes: DataFrame) -> DataFrame:
    """Records whose ``api_hash`` (hex) is not in the ledger; done before any payload is read."""
    known = ledger_hashes.select(F.col("api_hash").alias("_hash")).distinct()
    keyed = records.withColumn("_hash", hex_to_bytes("api_hash"))
    return keyed.join(known, "_hash", "left_anti").drop("_hash")


def with_file_ids(
    names: DataFrame, known_files: DataFrame, seq: list[str], start: int
) -> DataFrame:
    """``(file_name, file_id)`` of files not yet known, numbered in first-seen order from ``start``."""
    return dense_ids(names, "file_name", seq, "file_id", start, known_files)


def reconcile(feed: DataFrame, ledger: DataFrame, key: str = "api_hash") -> DataFrame:
    """Per hash how often the feed and the ledger hold it, and a status.

    Both sides are counted per hash first, so the join has unique keys.
    """
    f = feed.groupBy(key).agg(F.count(F.lit(1)).alias("n_feed"))
    held = ledger.groupBy(key).agg(F.count(F.lit(1)).alias("n_ledger"))
    status = (
        F.when(F.col("n_ledger").isNull(), "feed_only")
        .when(F.col("n_feed").isNull(), "ledger_only")
        .otherwise("both")
    )
    return f.join(held, key, "full").withColumn("status", status)


def verify_feed(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: feed records found and not found in the ledger, and hashes the feed lacks."""
    r = reconcile(feed, ledger)
    count = lambda status: F.coalesce(
        F.sum(F.when(F.col("status") == status, F.col("n_feed"))), F.lit(0)
    )
    return r.agg(
        count("both").alias("found"),
        count("feed_only").alias("not_found"),
        F.count_if(F.col("status") == "ledger_only").alias("not_seen_remote"),
    )


def verify_records(rescanned: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: written records whose ``record_hash`` is and is not in the ledger."""
    r = reconcile(rescanned, ledger, "record_hash").filter(F.col("n_feed").isNotNull())
    return r.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "both", F.col("n_feed"))), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(F.col("status") != "both", F.col("n_feed"))), F.lit(0)).alias("not_found"),
    )


class Ledger:
    """The ledger tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str) -> "Ledger":
        """Start an empty ledger with the job's key/value rows; an older one is truncated."""
        ledger = cls(spark, path)
        for table, columns in TABLES.items():
            if not exists(spark, f"{ledger.path}/{table}"):
                continue
            (
                spark.createDataFrame([], columns)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "static")
                .partitionBy("batch")
                .parquet(f"{ledger.path}/{table}")
            )
        ledger.put_metadata(
            {"api_version": schema.API_VERSION, "cli_version": schema.CLI_VERSION, "name": name}
        )
        return ledger

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Ledger":
        """Load an existing ledger; a missing one is an error."""
        ledger = cls(spark, path)
        if not exists(spark, f"{ledger.path}/metadata"):
            raise FileNotFoundError(f"no ledger at {path}")
        return ledger

    def table(self, name: str) -> DataFrame:
        """One table; it is empty until its first append."""
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def hashes(self, without_batch: str | None = None) -> DataFrame:
        rows = self.table("hashes")
        return rows if without_batch is None else rows.filter(F.col("batch") != without_batch)

    def append(self, table: str, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def put_metadata(self, pairs: dict[str, str], batch: str = "job") -> None:
        self.append("metadata", self.spark.createDataFrame(list(pairs.items()), "key string, value string"), batch)

    def get_metadata(self, key: str) -> str | None:
        row = self.table("metadata").filter(F.col("key") == key).select("value").limit(1).first()
        return row["value"] if row else None

    def file_names(self) -> DataFrame:
        return self.table("files").select("file_name").distinct()

    def _known(self, table: str, batch: str) -> DataFrame:
        return self.table(table).filter(F.col("batch") != batch)

    def register_files(self, names: DataFrame, seq: list[str], batch: str) -> DataFrame:
        """Give ids to the new file names of a batch (from 1 on) and return all known ones."""
        known = self._known("files", batch)
        top = known.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")).first()["top"]
        fresh = with_file_ids(names, known, seq, top + 1)
        self.append("files", fresh.select(F.col("file_id").cast("int"), "file_name"), batch)
        return self.table("files").select("file_name", "file_id")

    def register_labels(self, labels: DataFrame, seq: list[str], batch: str) -> DataFrame:
        """Give ids to the new labels of a batch (from 0 on) and return all known ones."""
        known = self._known("labels", batch)
        top = known.agg(F.coalesce(F.max("category_id"), F.lit(-1)).alias("top")).first()["top"]
        self.append("labels", dense_ids(labels, "label", seq, "category_id", top + 1, known), batch)
        return self.table("labels").select("label", "category_id")

    def append_hashes(self, rows: DataFrame, batch: str) -> None:
        """Record ``(file_id, api_hash, record_hash, member_pos)`` as hex; the first per key wins.

        ``rows`` also has ``seq``. The batch's own earlier rows are left out of
        the comparison, so that a repeated batch does not drop itself.
        """
        keyed = rows.select(
            F.col("file_id").cast("int"),
            hex_to_bytes("api_hash").alias("api_hash"),
            hex_to_bytes("record_hash").alias("record_hash"),
            "member_pos",
            "seq",
        )
        firsts = (
            keyed.groupBy("api_hash", "member_pos")
            .agg(F.min_by(F.struct("file_id", "record_hash"), "seq").alias("_r"))
            .select(
                F.col("_r.file_id").alias("file_id"),
                "api_hash",
                F.col("_r.record_hash").alias("record_hash"),
                "member_pos",
            )
        )
        known = self.hashes(without_batch=batch).select("api_hash", "member_pos").distinct()
        self.append("hashes", firsts.join(known, ["api_hash", "member_pos"], "left_anti"), batch)
