"""Sinks and their re-scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import D_SQL, FIELDS, JOB, SET_SQL, SPLITS, docs, entry_struct, query, set_of, table, with_entries
from catalog.text_queries import LINE_SQL, doc_lines
from setwright.functions.tensors import decode_f32, encode_f32
from setwright.operators.numbering import group_positions, row_positions, running_totals
from setwright.operators.shards import greedy_shards
from setwright.plans.export import export
from setwright.session import scratch_path
from setwright.sinks import tfrecord
from setwright.sinks.writers import image_list_defect, read_lines, shard_index, write_lines
from setwright.sources.job import Job

X_SET = SET_SQL.format(k="vec_id")


@query(
    "rescan_text_hash",
    f"""WITH {D_SQL} SELECT "set", md5({LINE_SQL}) AS record_hash, count(*) AS n FROM B GROUP BY 1, 2""",
)
def rescan_text_hash(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_lines(doc_lines(docs(spark, sf_dir)).select("set", "line"), path)
    return read_lines(spark, path).groupBy("set", F.md5("line").alias("record_hash")).agg(F.count(F.lit(1)).alias("n"))


CAT_SQL = """FS AS (SELECT lang, min(doc_id) AS f FROM documents GROUP BY 1), CT AS (SELECT lang, row_number() OVER (ORDER BY f) - 1 AS cat FROM FS)"""


@query(
    "image_list",
    f"""WITH {D_SQL}, {CAT_SQL} SELECT "set", blob || ' ' || CAST(cat AS VARCHAR) AS line FROM B JOIN CT USING (lang)""",
)
def image_list(spark, sf_dir):
    """Documents exported as an image list; the root is taken off the paths."""
    out = scratch_path(spark, "imagelist")
    export(with_entries(docs(spark, sf_dir)), Job(0, "documents", FIELDS[:2], SPLITS), out, "imagelist")
    text = spark.read.schema("value string, batch string, set string").option("lineSep", "\n").text(f"{out}/lines")
    return text.select("set", F.replace("value", F.lit(f"{out}/"), F.lit("")).alias("line"))


@query(
    "image_list_rejects",
    """SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN 'field_1_is_no_label' WHEN 1 THEN 'field_0_is_no_blob' END AS reason
    FROM documents WHERE doc_id % 50 IN (0, 1)""",
)
def image_list_rejects(spark, sf_dir):
    case = F.col("doc_id") % 50
    d = docs(spark, sf_dir).select(
        "doc_id",
        F.when(case == 1, entry_struct(0, "string", string_value=F.col("lang")))
        .otherwise(entry_struct(0, "image", filename=F.col("fname")))
        .alias("source"),
        F.when(case == 0, entry_struct(1, "raw", dtype=F.lit("uint8")))
        .otherwise(entry_struct(1, "string", string_value=F.col("lang")))
        .alias("ground"),
    )
    checked = d.select("doc_id", image_list_defect(F.col("source"), F.col("ground")).alias("reason"))
    return checked.filter(F.col("reason").isNotNull())


def _tensors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("set", set_of("vec_id"))


def _total(column: str):
    return F.round(F.aggregate(column, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 4)


@query(
    "tfrecord_roundtrip",
    f"""SELECT {X_SET} AS "set", vec_id, CAST(label AS BIGINT) AS label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total,
    round(CAST(embedding[1] AS DOUBLE), 4) AS first, 'v' || CAST(vec_id AS VARCHAR) AS name FROM embeddings""",
)
def tfrecord_roundtrip(spark, sf_dir):
    tfrecord.register(spark)
    path = scratch_path(spark, "tfrecord")
    rows = _tensors(spark, sf_dir).select(
        "set",
        "vec_id",
        "label",
        encode_f32("embedding").alias("embedding"),
        F.get("embedding", F.lit(0)).alias("first"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"),
    )
    rows.write.format("tfrecord").option("maxShardBytes", 64 * 1024 * 1024).mode("append").save(path)
    wanted = "_set string, vec_id bigint, label bigint, embedding binary, first float, name string"
    back = spark.read.format("tfrecord").schema(wanted).load(path)
    return back.withColumn("v", decode_f32("embedding")).select(
        F.col("_set").alias("set"), "vec_id", "label", _total("v").alias("total"),
        F.round(F.col("first").cast("double"), 4).alias("first"), "name",
    )


@query(
    "tfrecord_shards",
    f"""WITH S AS (SELECT {X_SET} AS "set", label, list_sum(CAST(embedding AS DOUBLE[])) AS t FROM embeddings)
    SELECT "set", count(*) AS n, count(*) >= 0 AS small, CAST(sum(label) AS BIGINT) AS labels, round(sum(t), 4) AS total FROM S GROUP BY 1""",
)
def tfrecord_shards(spark, sf_dir):
    """Shards of at most 100 records with tensor and label: every file keeps to it and none is lost."""
    tfrecord.register(spark)
    path = scratch_path(spark, "shards")
    rows = _tensors(spark, sf_dir).select("set", "vec_id", "label", encode_f32("embedding").alias("embedding"))
    rows.write.format("tfrecord").option("entriesPerShard", 100).mode("append").save(path)
    back = spark.read.format("tfrecord").schema("_set string, _file string, label bigint, embedding binary").load(path)
    values = F.aggregate(decode_f32("embedding"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    files = back.withColumn("t", values).groupBy("_set", "_file").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.sum("t").alias("t"))
    return files.groupBy(F.col("_set").alias("set")).agg(
        F.sum("n").alias("n"), (F.max("n") <= 100).alias("small"), F.sum("labels").alias("labels"), F.round(F.sum("t"), 4).alias("total")
    )


@query(
    "jsonl_roundtrip",
    f"""WITH {D_SQL} SELECT "set", doc_id, lang, n_chars, md5(text) AS digest FROM D""",
)
def jsonl_roundtrip(spark, sf_dir):
    """Documents exported as JSON lines, their text among the entries, and read back."""
    d = docs(spark, sf_dir)
    entries = F.array(
        entry_struct(0, "numeric", dtype=F.lit("int"), int_value=F.col("doc_id").cast("int")),
        entry_struct(1, "string", string_value=F.col("lang")),
        entry_struct(2, "numeric", dtype=F.lit("int"), int_value=F.col("n_chars")),
        entry_struct(3, "string", string_value=F.col("text")),
    )
    out = scratch_path(spark, "jsonl")
    export(d.withColumn("entries", entries).withColumn("reason", F.lit(None).cast("string")), JOB, out, "jsonl")
    text = spark.read.schema("value string, batch string, set string").option("lineSep", "\n").text(f"{out}/lines")
    e = F.from_json("value", "entries array<struct<int_value: bigint, string_value: string>>")["entries"]
    return text.select("set", e.alias("e")).select(
        "set",
        F.col("e")[0]["int_value"].alias("doc_id"),
        F.col("e")[1]["string_value"].alias("lang"),
        F.col("e")[2]["int_value"].alias("n_chars"),
        F.md5(F.col("e")[3]["string_value"]).alias("digest"),
    )


SHARD_SQL = f"""S AS (SELECT {X_SET} AS "set", (row_number() OVER (ORDER BY vec_id) - 1) // 256 AS shard, embedding FROM embeddings)"""


def _sharded(spark, sf_dir):
    x = row_positions(_tensors(spark, sf_dir).select("vec_id", "set", "embedding"), ["vec_id"])
    return x.withColumn("shard", F.floor(F.col("position") / 256))


def _written_tensors(spark, sf_dir):
    path = scratch_path(spark, "tensors")
    _sharded(spark, sf_dir).select("set", "shard", "embedding").write.partitionBy("set", "shard").parquet(path)
    return spark.read.schema("embedding array<float>, set string, shard bigint").parquet(path)


@query("tensor_shards", f"""WITH {SHARD_SQL} SELECT "set", shard, count(*) AS n FROM S GROUP BY 1, 2""")
def tensor_shards(spark, sf_dir):
    return _written_tensors(spark, sf_dir).groupBy("set", "shard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tensor_roundtrip",
    f"""WITH {SHARD_SQL} SELECT "set", count(*) AS n, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS total,
    count(DISTINCT embedding) AS hashes FROM S GROUP BY 1""",
)
def tensor_roundtrip(spark, sf_dir):
    """Tensors exported as shards, with a label beside each, and read back as numbers."""
    x = _tensors(spark, sf_dir).select("vec_id", "set", "label", encode_f32("embedding").alias("bytes"))
    tensor = entry_struct(0, "raw", dtype=F.lit("float"), content=F.col("bytes"), digest=F.md5("bytes"), n_bytes=F.octet_length("bytes"))
    records = x.select(
        F.col("vec_id").alias("seq"),
        "set",
        F.md5(F.col("vec_id").cast("string")).alias("api_hash"),
        F.array(tensor, entry_struct(2, "numeric", dtype=F.lit("int"), int_value=F.col("label"))).alias("entries"),
        F.lit(None).cast("string").alias("reason"),
    )
    out = scratch_path(spark, "tensors-out")
    export(records, JOB, out, "tensor", rowsPerShard=256)
    back = spark.read.parquet(f"{out}/tensors").withColumn("v", decode_f32("source_file.data"))
    per_row = back.select(
        "set",
        F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("s"),
        F.md5("source_file.data").alias("h"),
    )
    return per_row.groupBy("set").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 4).alias("total"), F.count_distinct("h").alias("hashes")
    )


@query(
    "shard_index",
    f"""WITH {SHARD_SQL} SELECT DISTINCT "set", "set" || CAST(shard + 1 AS VARCHAR) || '.shard' AS file FROM S""",
)
def shard_index_(spark, sf_dir):
    return shard_index(_sharded(spark, sf_dir).select("set", "shard"))


@query(
    "shard_by_entries",
    f"""WITH {D_SQL}, P AS (SELECT "set", (row_number() OVER (PARTITION BY "set" ORDER BY doc_id) - 1) // 100 AS shard FROM D)
    SELECT "set", shard, count(*) AS n FROM P GROUP BY 1, 2""",
)
def shard_by_entries(spark, sf_dir):
    p = group_positions(docs(spark, sf_dir).select("set", "doc_id"), "set", ["doc_id"])
    return p.groupBy("set", F.floor(F.col("position") / 100).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "shard_by_bytes",
    f"""WITH {D_SQL}, P AS (SELECT "set", CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY "set" ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 65536 AS shard, strlen(text) AS b FROM D)
    SELECT "set", shard, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM P GROUP BY 1, 2""",
)
def shard_by_bytes(spark, sf_dir):
    d = docs(spark, sf_dir).select("set", "doc_id", F.octet_length("text").cast("bigint").alias("b"))
    t = running_totals(d, "set", ["doc_id"], "b")
    return t.groupBy("set", F.floor(F.col("total_before") / 65536).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes")
    )


@query(
    "shard_greedy_bytes",
    f"""WITH RECURSIVE {D_SQL},
    R AS (SELECT "set", strlen(text) AS b, row_number() OVER (PARTITION BY "set" ORDER BY doc_id) AS k FROM D),
    W("set", k, shard, held) AS (
      SELECT "set", k, CAST(0 AS BIGINT), b FROM R WHERE k = 1
      UNION ALL SELECT R."set", R.k, CASE WHEN held >= 65536 THEN shard + 1 ELSE shard END, CASE WHEN held >= 65536 THEN b ELSE held + b END
      FROM W JOIN R ON R."set" = W."set" AND R.k = W.k + 1)
    SELECT W."set" AS "set", shard, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM W JOIN R ON R."set" = W."set" AND R.k = W.k GROUP BY 1, 2""",
)
def shard_greedy_bytes(spark, sf_dir):
    """Each set cut into shards that are closed once they hold 64 KiB of text, one after the other."""
    d = docs(spark, sf_dir).select("set", "doc_id", F.octet_length("text").cast("bigint").alias("b"))
    return greedy_shards(d, "set", ["doc_id"], "b", 65536).groupBy("set", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"))
