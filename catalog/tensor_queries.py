"""Tensors and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from setwright.functions.tensors import encode_f32
from setwright.operators.mean import image_channel_means, image_mean, mean_vector, subtract_mean, with_dim_check
from setwright.sources.assets import raw_tensors

CHANNELS = 4

V_SQL = "V AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def tensors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query(
    "raw_tensor_decode",
    """SELECT vec_id, CASE WHEN vec_id % 50 <> 0 AND vec_id % 50 <> 1 THEN CAST(len(embedding) AS BIGINT) END AS size,
    CASE WHEN vec_id % 50 <> 0 AND vec_id % 50 <> 1 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total,
    CASE vec_id % 50 WHEN 0 THEN 'bad_raw_length' WHEN 1 THEN 'bad_raw_dtype' END AS reason FROM embeddings""",
)
def raw_tensor_decode(spark, sf_dir):
    packed = tensors(spark, sf_dir).select("vec_id", encode_f32("embedding").alias("content"))
    case = F.col("vec_id") % 50
    rows = packed.select(
        "vec_id",
        F.when(case == 0, F.substring("content", 1, 255)).otherwise(F.col("content")).alias("content"),
        F.when(case == 1, "float64").otherwise("float").alias("dtype"),
    )
    total = F.aggregate("tensor", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return raw_tensors(rows).select(
        "vec_id",
        F.when(F.col("tensor").isNotNull(), F.size("tensor")).cast("bigint").alias("size"),
        F.round(total, 4).alias("total"),
        "reason",
    )


@query(
    "image_channel_mean",
    f"""WITH {V_SQL} SELECT vec_id, CAST(i % 4 AS BIGINT) AS ch, round(avg(v), 6) AS m FROM V GROUP BY 1, 2""",
)
def image_channel_mean(spark, sf_dir):
    m = image_channel_means(tensors(spark, sf_dir), "embedding", CHANNELS)
    return m.select("vec_id", F.col("ch").cast("bigint").alias("ch"), F.round("m", 6).alias("m"))


@query("global_mean", f"WITH {V_SQL} SELECT round(avg(v), 6) AS m FROM V")
def global_mean(spark, sf_dir):
    return image_mean(tensors(spark, sf_dir), "embedding", "global").select(F.round("m", 6).alias("m"))


@query("channel_mean", f"WITH {V_SQL} SELECT CAST(i % 4 AS BIGINT) AS ch, round(avg(v), 6) AS m FROM V GROUP BY 1")
def channel_mean(spark, sf_dir):
    m = image_mean(tensors(spark, sf_dir), "embedding", "channel", CHANNELS)
    return m.select(F.col("ch").cast("bigint").alias("ch"), F.round("m", 6).alias("m"))


@query("pixel_mean", f"WITH {V_SQL} SELECT i, round(avg(v), 6) AS m FROM V GROUP BY 1")
def pixel_mean(spark, sf_dir):
    m = image_mean(tensors(spark, sf_dir), "embedding", "pixel")
    return m.select(F.col("i").cast("bigint").alias("i"), F.round("m", 6).alias("m"))


def _subtracted(kind: str, group: str):
    mean = f"(SELECT avg(v) FROM V)" if not group else f"avg(v) OVER (PARTITION BY {group})"
    sql = f"WITH {V_SQL} SELECT vec_id, i, round(CAST(CAST(v - {mean} AS FLOAT) AS DOUBLE), 6) AS v FROM V"

    @query(f"subtract_mean_{kind}", sql)
    def run(spark, sf_dir):
        x = tensors(spark, sf_dir)
        mean = mean_vector(x, "embedding", kind, CHANNELS)
        less = subtract_mean(x, "embedding", mean, kind, CHANNELS)
        return less.select("vec_id", F.posexplode("embedding").alias("p", "x")).select(
            "vec_id", F.col("p").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("v")
        )

    return run


subtract_mean_global = _subtracted("global", "")
subtract_mean_channel = _subtracted("channel", "i % 4")
subtract_mean_pixel = _subtracted("pixel", "i")


@query(
    "dim_check",
    """SELECT vec_id, (vec_id % 50 = 0) = ((SELECT min(vec_id) FROM embeddings) % 50 = 0) AS ok FROM embeddings""",
)
def dim_check(spark, sf_dir):
    """Every fiftieth tensor, the first one among them, is cut to 60 values."""
    x = tensors(spark, sf_dir).withColumn(
        "embedding",
        F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")),
    )
    x = x.withColumn("width", F.size("embedding") / CHANNELS).withColumn("channels", F.lit(CHANNELS))
    return with_dim_check(x, ["width", "channels"], "vec_id").select("vec_id", "ok")
