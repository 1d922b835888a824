"""Scalar functions and output lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import D_SQL, FIELDS, docs, ledger_hashes, query, table, with_entries
from setwright.functions.text import (
    blob_path,
    ends_with,
    float_text,
    int_text,
    join_fields,
    join_tokens,
    key_values,
    md5_hex,
    quoted,
    set_of_shard,
    split_tokens,
)
from setwright.operators.entries import cell_text, composite_hash, output_line
from setwright.operators.ledger import new_records


@query("md5_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def md5_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5_hex("text").alias("digest"))


@query(
    "split_tokens",
    """SELECT page_id, CAST(len(t) AS BIGINT) AS n, t[len(t)] AS last FROM (
      SELECT page_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS t
      FROM (SELECT page_id, string_split(CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE url END, '/') AS p FROM pages))""",
)
def split_tokens_(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").select("page_id", split_tokens(url, "/").alias("t"))
    return p.select("page_id", F.size("t").cast("bigint").alias("n"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query(
    "join_tokens",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ', ' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', ' END || source AS joined FROM documents""",
)
def join_tokens_(spark, sf_dir):
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", join_tokens(F.array(first, F.lit(""), F.col("source"))).alias("joined")
    )


@query("ends_with", "SELECT page_id, ends_with(url, '#top') AS ok FROM pages")
def ends_with_(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ends_with("url", "#top").alias("ok"))


@query(
    "receipt_parse",
    f"""WITH {D_SQL} SELECT doc_id, "set" || '.txt' AS file, md5(text) AS hash FROM D""",
)
def receipt_parse(spark, sf_dir):
    """A later key of the same name is ignored, and so is text after a second '='."""
    receipt = F.concat(
        F.lit("file="), "set", F.lit(".txt;hash="), F.md5("text"), F.lit("=x;hash="), "lang", F.lit(";")
    )
    kv = docs(spark, sf_dir).select("doc_id", key_values(receipt).alias("kv"))
    return kv.select("doc_id", F.col("kv")["file"].alias("file"), F.col("kv")["hash"].alias("hash"))


@query(
    "format_float",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    printf('%f', CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE)) AS price,
    printf('%f', CAST(CAST(l_discount * -0.001953125 AS FLOAT) AS DOUBLE)) AS small FROM lineitem""",
)
def format_float(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        float_text("l_extendedprice").alias("price"),
        float_text(F.col("l_discount") * -0.001953125).alias("small"),
    )


NUMERIC_SQL = """printf('%f', CAST(CAST(l_quantity AS FLOAT) AS DOUBLE)) || ' ' || printf('%f', CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE))
    || ' ' || printf('%f', CAST(CAST(l_discount AS FLOAT) AS DOUBLE)) || ' ' || CAST(l_linenumber AS VARCHAR) || ' "' || l_returnflag || '"'"""


@query(
    "csv_lines_numeric",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, line, md5(line) AS record_hash
    FROM (SELECT l_orderkey, l_linenumber, {NUMERIC_SQL} AS line FROM lineitem)""",
)
def csv_lines_numeric(spark, sf_dir):
    # Cells are columns of their own, so that each is made once and looked at twice.
    cells = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        float_text("l_quantity").alias("c0"),
        float_text("l_extendedprice").alias("c1"),
        float_text("l_discount").alias("c2"),
        int_text("l_linenumber").alias("c3"),
        quoted("l_returnflag").alias("c4"),
    )
    line = join_fields([F.col(f"c{i}") for i in range(5)])
    lines = cells.select("l_orderkey", "l_linenumber", line.alias("line"))
    return lines.withColumn("record_hash", md5_hex("line"))


LINE_SQL = """blob || ' "' || lang || '" ' || CAST(n_chars AS VARCHAR)"""


def with_line(records):
    """The output line of each record with entries, and its hash."""
    cell = lambda e: cell_text(e, "", True)
    line = output_line(F.col("entries"), FIELDS[:3], cell)
    return records.withColumn("line", line).withColumn("record_hash", md5_hex("line"))


def doc_lines(records):
    """The output line of each document record and its hash."""
    return with_line(with_entries(records))


def new_doc_lines(spark, sf_dir):
    """Lines of the documents not in the ledger; hashes and sizes are taken where the text is, which moves nowhere."""
    prepared = with_entries(docs(spark, sf_dir)).drop("text")
    return with_line(new_records(prepared, ledger_hashes(spark, sf_dir)))


@query(
    "csv_lines",
    f"""WITH {D_SQL} SELECT "set", line, md5(line) AS record_hash FROM (SELECT "set", {LINE_SQL} AS line FROM N)""",
)
def csv_lines(spark, sf_dir):
    """The minimum slice: new records, typed entries, output line, hash."""
    return new_doc_lines(spark, sf_dir).select("set", "line", "record_hash")


@query(
    "blob_paths",
    """SELECT page_id, 'data/' || substr(f, 1, 1) || '/' || substr(f, 2, 1) || '/' || substr(f, 3, 1) || '/' || f AS tree,
    'data/' || f AS flat, 'data/p' || CAST(page_id AS VARCHAR) AS short
    FROM (SELECT page_id, md5(html) || '.html' AS f FROM pages)""",
)
def blob_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("f", F.concat(F.md5("html"), F.lit(".html")))
    return p.select(
        "page_id",
        blob_path("f").alias("tree"),
        blob_path("f", tree=False).alias("flat"),
        blob_path(F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("short"),
    )


@query(
    "composite_hash",
    "SELECT doc_id, md5(lang) || md5(source) || md5(CAST(n_chars AS VARCHAR)) AS record_hash FROM documents",
)
def composite_hash_(spark, sf_dir):
    parts = F.array("lang", "source", F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", composite_hash(F.transform(parts, lambda v: F.md5(v))).alias("record_hash")
    )


@query(
    "shard_set_name",
    """SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'test' ELSE 'validate' END AS "set" FROM embeddings""",
)
def shard_set_name(spark, sf_dir):
    from catalog.registry import set_of

    file = F.concat(set_of("vec_id"), F.floor(F.col("vec_id") / 256).cast("string"), F.lit(".h5"))
    return table(spark, sf_dir, "embeddings").select("vec_id", set_of_shard(file).alias("set"))
