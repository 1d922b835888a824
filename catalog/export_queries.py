"""Whole exports with pixels: means subtracted, images decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.asset_queries import BYTE_SQL, _png_of
from catalog.registry import SET_SQL, SPLITS, docs, entry_struct, query, set_of, table
from setwright.functions.tensors import decode_f32, encode_f32
from setwright.operators.ledger import Ledger
from setwright.plans.export import export, ledger_path, written_files
from setwright.session import scratch_path
from setwright.sinks import tfrecord
from setwright.sinks.writers import WRITERS
from setwright.sources.job import Field, Job

X_SET = SET_SQL.format(k="vec_id")
JOB = Job(0, "tensors", (Field(0, 10, "pixels"), Field(1, 11, "label")), SPLITS)
KINDS = ("global", "channel", "pixel")
URL = "http://h/"


def _records(x: DataFrame, kind: str, dtype: str) -> DataFrame:
    """Tensors as feed records, each with its bytes behind a URL and its label."""
    tensor = entry_struct(
        0, kind, dtype=F.lit(dtype), channels=F.lit(4), width=F.lit(4), height=F.lit(4), filename=F.concat("vec_id", F.lit(".bin")),
        url=F.concat(F.lit(URL), "vec_id"),
    )
    label = entry_struct(1, "numeric", dtype=F.lit("int"), int_value=F.col("label"))
    return x.select(
        F.col("vec_id").alias("seq"), set_of("vec_id").alias("set"), F.md5(F.col("vec_id").cast("string")).alias("api_hash"),
        F.array(tensor, label).alias("entries"), F.lit(None).cast("string").alias("reason"),
    )


def _assets(x: DataFrame, content) -> DataFrame:
    return x.select(F.concat(F.lit(URL), "vec_id").alias("url"), content.alias("content"))


def _difference(kind: str, group: str) -> str:
    mean = "(SELECT avg(v) FROM V)" if not group else f"avg(v) OVER (PARTITION BY {group})"
    return f"SELECT '{kind}' AS kind, vec_id, i, CAST(CAST(v - {mean} AS FLOAT) AS DOUBLE) AS v FROM V"


@query(
    "export_subtracted",
    f"""WITH V AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id % 50 <> 1),
    L AS ({_difference("global", "")} UNION ALL {_difference("channel", "i % 4")} UNION ALL {_difference("pixel", "i")}),
    S AS (SELECT kind, vec_id, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 5) AS most, round(min(v), 5) AS least,
      round(arg_min(v, i), 5) AS first, round(arg_max(v, i), 5) AS last FROM L GROUP BY 1, 2)
    SELECT kind, {X_SET} AS "set", label, n, total, most, least, first, last, CAST(NULL AS VARCHAR) AS reason FROM S JOIN embeddings USING (vec_id)
    UNION ALL SELECT kind, {X_SET}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unequal_dimensions' FROM embeddings, (VALUES ('global'), ('channel'), ('pixel')) AS k(kind)
    WHERE vec_id % 50 = 1""",
)
def export_subtracted(spark, sf_dir):
    """All tensors exported with each kind of mean subtracted; every fiftieth has other dimensions and is refused."""
    x = table(spark, sf_dir, "embeddings")
    tensor = F.when(F.col("vec_id") % 50 == 1, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    records, assets = _records(x, "raw", "float"), _assets(x, encode_f32(tensor))
    out = None
    for kind in KINDS:
        path = scratch_path(spark, f"subtracted-{kind}")
        done = export(records, JOB, path, "tensor", assets, subtract=kind, mean_format="parquet")
        v = spark.read.parquet(f"{path}/tensors").select("set", F.col("label.whole").alias("label"), decode_f32("pixels.data").alias("v"))
        total = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, e: a + e.cast("double"))
        figure = lambda c: F.round(c.cast("double"), 5)
        rows = v.select(
            F.lit(kind).alias("kind"), "set", "label", F.size("v").cast("bigint").alias("n"), F.round(total, 4).alias("total"),
            figure(F.array_max("v")).alias("most"), figure(F.array_min("v")).alias("least"),
            figure(F.get("v", F.lit(0))).alias("first"), figure(F.get("v", F.lit(63))).alias("last"), F.lit(None).cast("string").alias("reason"),
        )
        refused = done.rejects.select(F.lit(kind).alias("kind"), "set", "reason")
        rows = rows.unionByName(refused, allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return out


PIXELS_SQL = """array_to_string(list_transform(range(0, 64), lambda i:
      printf('%02X', p[1 + 4 * (i // 4) + CASE i % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE i % 4 END])), '')"""


@query(
    "export_decoded",
    f"""WITH P AS (SELECT vec_id, label, list_transform(embedding, lambda x: {BYTE_SQL}) AS p FROM embeddings),
    W AS (SELECT vec_id, {X_SET} AS "set", label, {PIXELS_SQL} AS pixels FROM P)
    SELECT f.fmt AS fmt, "set", CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 50 <> 0 THEN pixels END AS pixels,
      CASE WHEN vec_id % 50 = 0 THEN 'undecodable_image' END AS reason
    FROM W, (VALUES ('tensor'), ('tfrecords')) AS f(fmt) WHERE vec_id % 50 <> 0
    UNION ALL SELECT f.fmt, "set", NULL, NULL, 'undecodable_image' FROM W, (VALUES ('tensor'), ('tfrecords')) AS f(fmt) WHERE vec_id % 50 = 0""",
)
def export_decoded(spark, sf_dir):
    """Pictures behind URLs exported as pixels, to tensors and to records; every fiftieth is cut short and refused."""
    one = F.lit(1.0)
    pixels = F.transform("embedding", lambda x: F.floor((F.greatest(F.least(x.cast("double"), one), -one) + 1.0) * 127.5).cast("int"))
    x = table(spark, sf_dir, "embeddings")
    png = x.select("vec_id", _png_of(pixels).alias("png"))
    assets = _assets(png, F.when(F.col("vec_id") % 50 == 0, F.substring("png", 1, 40)).otherwise(F.col("png")))
    records = _records(x, "image", "uint8")
    out = None
    for fmt in ("tensor", "tfrecords"):
        path = scratch_path(spark, f"decoded-{fmt}")
        done = export(records, JOB, path, fmt, assets, decode=True)
        if fmt == "tensor":
            back = spark.read.parquet(f"{path}/tensors").select("set", F.col("label.whole").cast("bigint").alias("label"), F.col("pixels.data").alias("data"))
        else:
            tfrecord.register(spark)
            back = spark.read.format("tfrecord").schema("_set string, label bigint, pixels binary").load(f"{path}/records")
            back = back.select(F.col("_set").alias("set"), "label", F.col("pixels").alias("data"))
        rows = back.select(F.lit(fmt).alias("fmt"), "set", "label", F.hex("data").alias("pixels"), F.lit(None).cast("string").alias("reason"))
        rows = rows.unionByName(done.rejects.select(F.lit(fmt).alias("fmt"), "set", "reason"), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return out


FORMATS = ("csv", "jsonl", "tensor", "tfrecords")


@query(
    "export_receipts",
    f"""WITH D AS (SELECT {SET_SQL.format(k="doc_id")} AS "set" FROM documents)
    SELECT fmt, "set", count(*) AS records, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS unlisted FROM D,
      (VALUES ('csv'), ('jsonl'), ('tensor'), ('tfrecords')) AS f(fmt) GROUP BY 1, 2""",
)
def export_receipts(spark, sf_dir):
    """Documents exported in two batches: every ledger row names a file that holds its record, and the index lists no other files."""
    d = docs(spark, sf_dir)
    entries = F.array(
        entry_struct(0, "string", string_value=F.col("source")), entry_struct(1, "string", string_value=F.col("lang")),
        entry_struct(2, "numeric", dtype=F.lit("int"), int_value=F.col("doc_id").cast("int")),
    )
    records = d.select("seq", "set", "api_hash", entries.alias("entries"), F.lit(None).cast("string").alias("reason"))
    job = Job(0, "documents", (Field(0, 10, "source"), Field(1, 11, "lang"), Field(2, 12, "id")), SPLITS)
    shards = {"tfrecords": {"entriesPerShard": 100}, "tensor": {"rowsPerShard": 100}}
    out = None
    for fmt in FORMATS:
        path = scratch_path(spark, f"receipts-{fmt}")
        for k, mode in enumerate(("new", "resume")):
            export(records.filter(F.col("seq") % 2 == k), job, path, fmt, mode=mode, batch=str(k), **shards.get(fmt, {}))
        ledger = Ledger.open(spark, ledger_path(path))
        named = ledger.hashes().join(ledger.table("files").select("file_id", "file_name"), "file_id")
        named = named.select("file_name", F.lower(F.hex("record_hash")).alias("record_hash"))
        held = WRITERS[fmt].rescan(spark, path).select("file_name", "record_hash").distinct()
        lost = named.join(held.withColumn("there", F.lit(True)), ["file_name", "record_hash"], "left").filter("there IS NULL")
        index = written_files(spark, path, fmt)
        unlisted = index.join(named.select("file_name").distinct(), "file_name", "left_anti")
        per_set = lambda rows, name: rows.groupBy(F.regexp_extract("file_name", "/set=([^/]+)/", 1).alias("set")).agg(F.count(F.lit(1)).alias(name))
        rows = per_set(named, "records").join(per_set(lost, "lost"), "set", "left").join(per_set(unlisted, "unlisted"), "set", "left")
        rows = rows.select(F.lit(fmt).alias("fmt"), "set", "records", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("unlisted", F.lit(0)).alias("unlisted"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "tensor_rescan",
    """SELECT md5(CAST(source AS VARCHAR)) || md5(lang) || md5(CAST(doc_id AS VARCHAR)) AS record_hash, count(*) AS n FROM documents GROUP BY 1""",
)
def tensor_rescan(spark, sf_dir):
    """Tensor shards written by an export, read back and hashed field by field."""
    d = docs(spark, sf_dir)
    entries = F.array(
        entry_struct(0, "string", string_value=F.col("source")), entry_struct(1, "string", string_value=F.col("lang")),
        entry_struct(2, "numeric", dtype=F.lit("int"), int_value=F.col("doc_id").cast("int")),
    )
    records = d.select("seq", "set", "api_hash", entries.alias("entries"), F.lit(None).cast("string").alias("reason"))
    job = Job(0, "documents", (Field(0, 10, "source"), Field(1, 11, "lang"), Field(2, 12, "id")), SPLITS)
    path = scratch_path(spark, "rescan")
    export(records, job, path, "tensor", rowsPerShard=256)
    return WRITERS["tensor"].rescan(spark, path).groupBy("record_hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_lookup",
    """SELECT 'records:' || source AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY source
    UNION ALL SELECT 'nobody', NULL""",
)
def ledger_lookup(spark, sf_dir):
    """Values of a ledger looked up one key at a time, and one that is not there."""
    ledger = Ledger.create(spark, scratch_path(spark, "lookup"), "documents")
    per_source = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("records:"), "source").alias("key"), F.col("n").cast("string").alias("value"))
    ledger.append("metadata", per_source, "sources")
    keys = table(spark, sf_dir, "documents").select(F.concat(F.lit("records:"), "source").alias("key")).distinct()
    asked = keys.agg(F.sort_array(F.collect_list("key")).alias("k")).first()["k"] + ["nobody"]
    return spark.createDataFrame([(k, ledger.get_metadata(k)) for k in asked], "key string, value string")
