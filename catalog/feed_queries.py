"""Scans, parsing, projections and filters of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import D_SQL, FIELDS, PAGE, docs, entry_struct, query, table
from setwright.functions.text import bytes_to_hex, default_filename, hex_to_bytes, is_hash_text
from setwright.operators.entries import is_blob, output_cells
from setwright.operators.numbering import batch_numbers, group_positions, row_positions, running_totals
from setwright.session import scratch_path
from setwright.sources import feed, job
from setwright.sources.arrays import array_records


def as_pages(records: DataFrame, key: str) -> DataFrame:
    """``(page, body)`` from ``(key, json)``: pages of 256 in key order, each bounded by that."""
    numbered = row_positions(records, [key])
    return numbered.groupBy(F.floor(F.col("position") / PAGE).alias("page")).agg(
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("position", "json"))), lambda r: r["json"]
                ),
                ",",
            ),
            F.lit("]"),
        ).alias("body")
    )


def doc_json(*extra) -> F.Column:
    return F.to_json(
        F.struct(
            "set",
            F.col("api_hash").alias("hash"),
            F.array(
                F.to_variant_object(F.struct(F.lit("string").alias("type"), F.lit(11).alias("fieldid"), F.col("lang").alias("value"))),
                F.to_variant_object(F.struct(F.lit("numeric").alias("type"), F.lit("int").alias("dtype"), F.lit(2).alias("id"), F.col("n_chars").alias("value"))),
                F.to_variant_object(F.struct(F.lit("string").alias("type"), F.lit("body").alias("name"), F.col("text").alias("value"))),
            ).alias("data"),
            *extra,
        )
    )


@query(
    "job_metadata",
    f"""WITH {D_SQL}, J AS (SELECT source, count(*) AS n FROM D GROUP BY source),
    F(pos, id, field_id, name) AS (VALUES (0, 0, 10, 'source_file'), (1, 1, 11, 'label'), (2, 2, 12, 'size'), (3, 3, 13, 'body')),
    S AS (SELECT source, "set", count(*) AS k FROM D GROUP BY source, "set")
    SELECT J.source AS dataset, CAST(n AS BIGINT) AS count, CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id,
           CAST(field_id AS BIGINT) AS field_id, name, "set", CAST(floor(k * 100.0 / n) AS BIGINT) AS declared_pct
    FROM J CROSS JOIN F JOIN S ON S.source = J.source""",
)
def job_metadata(spark, sf_dir):
    """One job document per document source, written as JSON and scanned."""
    per_set = docs(spark, sf_dir).groupBy("source", "set").agg(F.count(F.lit(1)).alias("k"))
    sets = F.collect_list(F.struct("set", "k"))  # at most three per source
    documents = per_set.groupBy("source").agg(F.sum("k").alias("n"), sets.alias("sets")).select(
        F.to_json(
            F.struct(
                F.col("n").alias("count"),
                F.struct(F.lit(1).alias("id"), F.col("source").alias("name")).alias("dataset"),
                F.array(
                    *[F.struct(F.lit(f.id).alias("id"), F.lit(f.name).alias("name"), F.lit(f.field_id).alias("fieldid")) for f in FIELDS]
                ).alias("mapping"),
                F.map_from_entries(
                    F.transform("sets", lambda s: F.struct(s["set"], F.floor(s["k"] * 100.0 / F.col("n"))))
                ).alias("splits"),
                F.lit("ignored").alias("comment"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "jobs")
    documents.write.text(path)
    jobs = job.require_complete(job.read_jobs(spark, path, multiline=False)).withColumn("ds", F.col("dataset.name"))
    fields = job.fields(jobs, "ds", "count")
    return fields.join(job.splits(jobs, "ds"), "ds").select(
        F.col("ds").alias("dataset"),
        F.col("count").cast("bigint").alias("count"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("id").cast("bigint").alias("id"),
        F.col("field_id").cast("bigint").alias("field_id"),
        "name",
        "set",
        F.col("declared_pct").cast("bigint").alias("declared_pct"),
    )


@query(
    "feed_parse",
    f"""WITH {D_SQL} SELECT CAST(doc_id % 256 AS BIGINT) AS pos, api_hash, "set",
    lang, n_chars, md5(text) AS body_md5 FROM D""",
)
def feed_parse(spark, sf_dir):
    """All documents as pages of JSON text on disk, one page per line, scanned and typed again."""
    pages = as_pages(docs(spark, sf_dir).select("doc_id", doc_json().alias("json")), "doc_id")
    path = scratch_path(spark, "feed")
    pages.select("body").write.text(path)
    records = feed.accepted(feed.read_feed(feed.read_pages(spark, path, one_page_per="line"), FIELDS))
    e = F.col("entries")
    return records.select(
        F.col("pos").cast("bigint").alias("pos"),
        "api_hash",
        "set",
        e[0]["string_value"].alias("lang"),
        e[1]["int_value"].cast("bigint").alias("n_chars"),
        F.md5(e[2]["string_value"]).alias("body_md5"),
    )


@query(
    "feed_parse_repeated_key",
    f"""WITH {D_SQL} SELECT api_hash, "set", lang, n_chars FROM D""",
)
def feed_parse_repeated_key(spark, sf_dir):
    """Pages whose records and entries name a key twice: the last value counts, and nothing is refused."""
    json = F.regexp_replace(doc_json(), r'"(value|hash)":', r'"$1":"other","$1":')
    pages = as_pages(docs(spark, sf_dir).select("doc_id", json.alias("json")), "doc_id")
    records = feed.accepted(feed.read_feed(pages, FIELDS))
    e = F.col("entries")
    return records.select(
        "api_hash", "set", e[0]["string_value"].alias("lang"), e[1]["int_value"].cast("bigint").alias("n_chars")
    )


@query(
    "feed_parse_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS members FROM events""",
)
def feed_parse_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.parse_json("props"))
    return e.select(
        "event_id",
        F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.size(F.json_object_keys("props")).cast("bigint").alias("members"),
    )


@query(
    "batch_assign",
    """SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 256) AS BIGINT) AS batch_id FROM documents""",
)
def batch_assign(spark, sf_dir):
    return batch_numbers(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], PAGE)


def _grouped_lines(spark, sf_dir):
    """Line items in groups, the largest of which has no key, with amounts of both signs and halves."""
    amount = (F.col("l_linenumber") % 5 - 2) * F.lit(0.5).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), amount.alias("amount")
    )


LINES_SQL = """L AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag,
    CAST((l_linenumber % 5 - 2) * 0.5 AS DOUBLE) AS amount FROM lineitem)"""


@query(
    "group_positions_null",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, flag,
    row_number() OVER (PARTITION BY flag ORDER BY l_orderkey, l_linenumber) - 1 AS position FROM L""",
)
def group_positions_null(spark, sf_dir):
    lines = _grouped_lines(spark, sf_dir).drop("amount")
    return group_positions(lines, "flag", ["l_orderkey", "l_linenumber"])


@query(
    "running_totals_signed",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, flag, amount, coalesce(sum(amount) OVER (PARTITION BY flag
    ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total_before FROM L""",
)
def running_totals_signed(spark, sf_dir):
    return running_totals(_grouped_lines(spark, sf_dir), "flag", ["l_orderkey", "l_linenumber"], "amount")


@query(
    "batch_count",
    """SELECT count(*) AS n, CAST(ceil(count(*) / 256.0) AS BIGINT) AS batches FROM documents""",
)
def batch_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.ceil(F.col("n") / PAGE).alias("batches")
    )


@query("page_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 256 OFFSET 256")
def page_slice(spark, sf_dir):
    """One page; offset and limit together bound what each task keeps."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").offset(PAGE).limit(PAGE)


@query(
    "random_sample_count",
    "SELECT least(256, count(*)) AS n, least(256, count(*)) AS distinct_ids FROM documents",
)
def random_sample_count(spark, sf_dir):
    sample = feed.random_sample(table(spark, sf_dir, "documents").select("doc_id"), PAGE, seed=7)
    return sample.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("distinct_ids")
    )


@query(
    "page_plan",
    """WITH C AS (SELECT count(*) AS n FROM documents)
    SELECT b AS batch, 'fetch?size=256&offset=' || CAST(b * 256 AS VARCHAR) || '&iteration=0' AS url
    FROM (SELECT unnest(range(0, CAST(ceil(n / 256.0) AS BIGINT))) AS b FROM C)""",
)
def page_plan(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    plan = feed.page_plan(F.col("n"), PAGE, F.lit("fetch?size=$BATCHSIZE&offset=$OFFSET&iteration=$ITERATION"), F.lit(0))
    return n.select(F.explode(plan).alias("p")).select("p.batch", "p.url")


# --- projections ------------------------------------------------------------------


def parsed_entries(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows with a JSON ``entry`` to the typed entry's members."""
    return rows.select(
        *keep, feed.parse_entry(F.try_parse_json("entry"), FIELDS).alias("e")
    )


MAP_SQL = f"""WITH {D_SQL}, M(field_id, id, name) AS (VALUES (10, 0, 'source_file'), (11, 1, 'label'), (12, 2, 'size'), (13, 3, 'body')),
    E AS (SELECT doc_id, unnest([0, 1, 2]) AS k, lang, n_chars FROM D)
    SELECT doc_id, CAST(M.id AS BIGINT) AS out_id, M.name AS out_name,
           CASE k WHEN 2 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN lang ELSE 'f' END AS value
    FROM E JOIN M ON M.field_id = 10 + k"""


def _doc_entries_json(by: str):
    def one(k: int, value, numeric=False):
        where = {"fieldid": F.lit(10 + k)} if by == "fieldid" else {"name": F.lit(FIELDS[k].name), "id": F.lit(99)}
        kind = {"type": F.lit("numeric"), "dtype": F.lit("int")} if numeric else {"type": F.lit("string")}
        return F.to_json(F.struct(*[c.alias(n) for n, c in {**kind, **where, "value": value}.items()]))

    return F.array(one(0, F.lit("f")), one(1, F.col("lang")), one(2, F.col("n_chars"), numeric=True))


def _mapped(spark, sf_dir, by):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(_doc_entries_json(by)).alias("entry"))
    names = F.create_map(*[F.lit(v) for f in FIELDS for v in (f.id, f.name)])
    return parsed_entries(rows, "doc_id").filter(F.col("e.reason").isNull()).select(
        "doc_id",
        F.col("e.id").cast("bigint").alias("out_id"),
        names[F.col("e.id")].alias("out_name"),
        F.coalesce(F.col("e.string_value"), F.col("e.int_value").cast("string")).alias("value"),
    )


@query("map_field_id", MAP_SQL)
def map_field_id(spark, sf_dir):
    return _mapped(spark, sf_dir, "fieldid")


@query("map_field_name", MAP_SQL)
def map_field_name(spark, sf_dir):
    """The name is looked up before the id that the entry gives itself."""
    return _mapped(spark, sf_dir, "name")


@query(
    "typed_value",
    """SELECT event_id,
      CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS int_value,
      CASE WHEN event_id % 4 = 1 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END AS float_value,
      CASE WHEN event_id % 4 = 2 THEN event_type END AS string_value,
      CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 8 = 3 THEN 'missing_dtype' ELSE 'bad_dtype' END END AS reason
    FROM events""",
)
def typed_value(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    case = F.col("event_id") % 4

    def entry(kind, value, dtype=None):
        members = [F.lit(kind).alias("type"), F.lit(2).alias("id"), value.alias("value")]
        return F.to_json(F.struct(*members, *([dtype.alias("dtype")] if dtype is not None else [])))

    rows = e.withColumn(
        "entry",
        F.when(case == 0, entry("numeric", k, F.lit("int")))
        .when(case == 1, entry("numeric", F.col("value"), F.lit("float")))
        .when(case == 2, entry("string", F.col("event_type")))
        .otherwise(entry("numeric", k, F.when(F.col("event_id") % 8 == 7, "int64"))),
    )
    return parsed_entries(rows, "event_id").select(
        "event_id",
        F.when(F.col("e.reason").isNull(), F.col("e.int_value")).cast("bigint").alias("int_value"),
        F.when(F.col("e.reason").isNull(), F.col("e.float_value")).cast("double").alias("float_value"),
        F.col("e.string_value").alias("string_value"),
        F.col("e.reason").alias("reason"),
    )


@query(
    "pivot_entries",
    """SELECT doc_id, source || '!' AS c0, lang AS c1, CAST(n_chars AS VARCHAR) || '7' AS c2, '' AS c3 FROM documents""",
)
def pivot_entries(spark, sf_dir):
    """Entries to output columns: of two strings the last counts, two numbers are appended."""
    text = lambda i, c: entry_struct(i, "string", string_value=c)
    number = lambda i, c: entry_struct(i, "numeric", dtype=F.lit("int"), int_value=c)
    entries = F.array(
        number(2, F.col("n_chars")),
        text(0, F.lit("first")),
        text(1, F.col("lang")),
        number(2, F.lit(7)),
        text(0, F.concat("source", F.lit("!"))),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", entries.alias("entries"))
    cell = lambda e: F.coalesce(e["string_value"], e["int_value"].cast("string"))
    cells = d.select("doc_id", output_cells(F.col("entries"), FIELDS, cell).alias("cells"))
    return cells.select("doc_id", *[F.col("cells")[i].alias(f"c{i}") for i in range(len(FIELDS))])


@query(
    "default_filename",
    """SELECT page_id, md5(url) || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '' END AS filename FROM pages""",
)
def default_filename_(spark, sf_dir):
    dtype = F.when(F.col("page_id") % 3 == 0, "jpeg").when(F.col("page_id") % 3 == 1, "png").otherwise("uint8")
    return table(spark, sf_dir, "pages").select("page_id", default_filename("url", dtype).alias("filename"))


@query(
    "optional_fields",
    """SELECT doc_id, key, CAST(pos - 1 AS BIGINT) AS value_pos, vals[pos] AS value FROM (
      SELECT doc_id, key, vals, unnest(range(1, len(vals) + 1)) AS pos FROM (
        SELECT doc_id, 'tags' AS key, [lang, source] AS vals FROM documents
        UNION ALL SELECT doc_id, 'sizes', [CAST(n_chars AS VARCHAR)] FROM documents))""",
)
def optional_fields(spark, sf_dir):
    """Unknown keys that hold arrays are kept; a scalar is not, though it looks like one."""
    entry = F.to_json(
        F.struct(
            F.lit("string").alias("type"),
            F.lit(1).alias("id"),
            F.col("lang").alias("value"),
            F.array("lang", "source").alias("tags"),
            F.array("n_chars").alias("sizes"),
            F.concat(F.lit("["), "source").alias("note"),
            F.col("n_chars").alias("n"),
        )
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", entry.alias("entry"))
    return (
        parsed_entries(rows, "doc_id")
        .select("doc_id", F.explode("e.optional").alias("key", "vals"))
        .select("doc_id", "key", F.posexplode("vals").alias("p", "value"))
        .select("doc_id", "key", F.col("p").cast("bigint").alias("value_pos"), "value")
    )


# --- filters -----------------------------------------------------------------------


@query(
    "strict_keys",
    """SELECT CAST(floor(doc_id / 256) AS BIGINT) AS page, bool_and(doc_id % 700 NOT IN (0, 300, 560)) AS ok,
    CASE min(CASE WHEN doc_id % 700 = 0 THEN doc_id * 2 WHEN doc_id % 700 IN (300, 560) THEN doc_id * 2 + 1 END) % 2 WHEN 0 THEN 'unknown_key' WHEN 1 THEN 'not_an_object' END AS reason
    FROM documents GROUP BY 1""",
)
def strict_keys(spark, sf_dir):
    """Pages with a record that has an extra key or is no object (a string that holds one is none) are refused as a whole."""
    bad_key = doc_json(F.when(F.col("doc_id") % 700 == 0, 1).alias("extra"))
    json = F.when(F.col("doc_id") % 700 == 300, F.col("doc_id").cast("string")).otherwise(bad_key)
    quoted = F.get(F.split(F.to_json(F.struct(doc_json().alias("s"))), r'^\{"s":'), F.lit(1))
    json = F.when(F.col("doc_id") % 700 == 560, F.left(quoted, F.char_length(quoted) - 1)).otherwise(json)
    pages = as_pages(docs(spark, sf_dir).select("doc_id", json.alias("json")), "doc_id")
    return feed.page_status(pages)


@query(
    "feed_split",
    f"""WITH {D_SQL} SELECT "set", api_hash, lang, CAST(n_chars AS BIGINT) AS n_chars, md5(text) AS digest, CAST(NULL AS VARCHAR) AS reason FROM D""",
)
def feed_split(spark, sf_dir):
    """Documents as a few array files, cut into records by splits of the files, and parsed."""
    path = scratch_path(spark, "arrays")
    pages = as_pages(docs(spark, sf_dir).select("doc_id", doc_json().alias("json")), "doc_id")
    pages.select(F.col("body").alias("value"), "page").write.partitionBy("page").text(path)
    records = feed.read_feed(array_records(spark, path), FIELDS, strict="record")
    e = lambda i: F.get("entries", F.lit(i))
    return records.select(
        "set", "api_hash", e(0)["string_value"].alias("lang"), e(1)["int_value"].cast("bigint").alias("n_chars"),
        F.md5(e(2)["string_value"]).alias("digest"), "reason",
    )


# Rule-made defects, one per residue; every document is checked.
DEFECTS = {
    0: ("missing_type", {"id": 1, "value": "x"}),
    1: ("unknown_field", {"type": "string", "fieldid": 99, "value": "x"}),
    2: ("missing_dtype", {"type": "numeric", "id": 2, "value": 5}),
    3: ("value_on_blob", {"type": "image", "id": 0, "value": "x"}),
    4: ("no_output_id", {"type": "string", "value": "x"}),
    5: ("url_on_scalar", {"type": "string", "id": 1, "url": "http://h/x"}),
    6: ("bad_dtype", {"type": "numeric", "dtype": "double", "id": 2, "value": 5}),
    7: ("bad_value", {"type": "numeric", "dtype": "int", "id": 2, "value": "five"}),
    8: (None, {"type": "archive", "url": "http://h/x.tar"}),
}


@query(
    "entry_validity",
    "SELECT doc_id, CASE doc_id % 50 "
    + " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in DEFECTS.items() if r)
    + " END AS reason FROM documents",
)
def entry_validity(spark, sf_dir):
    import json

    entry = F.to_json(F.struct(F.lit("string").alias("type"), F.lit(1).alias("id"), F.col("lang").alias("value")))
    for k, (_, members) in DEFECTS.items():
        entry = F.when(F.col("doc_id") % 50 == k, json.dumps(members)).otherwise(entry)
    rows = table(spark, sf_dir, "documents").select("doc_id", entry.alias("entry"))
    return parsed_entries(rows, "doc_id").select("doc_id", F.col("e.reason").alias("reason"))


@query("value_type_filter", "SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1)")
def value_type_filter(spark, sf_dir):
    kinds = ("image", "raw", "archive", "string", "numeric")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(kind.alias("type")).alias("e"))
    return d.filter(is_blob(F.col("e"))).select("doc_id")


@query(
    "hash_validity",
    """SELECT doc_id, doc_id % 50 NOT IN (0, 1, 2) AS ok,
    CASE WHEN doc_id % 50 NOT IN (0, 1, 2) THEN md5(CAST(doc_id AS VARCHAR)) END AS stored FROM documents""",
)
def hash_validity(spark, sf_dir):
    h = F.md5(F.col("doc_id").cast("string"))
    given = (
        F.when(F.col("doc_id") % 50 == 0, F.substring(h, 1, 31))
        .when(F.col("doc_id") % 50 == 1, F.concat(F.lit("zz"), h))
        .when(F.col("doc_id") % 50 == 2, "")
        .otherwise(F.upper(h))
    )
    d = table(spark, sf_dir, "documents").select("doc_id", given.alias("h"))
    return d.select("doc_id", is_hash_text("h").alias("ok"), bytes_to_hex(hex_to_bytes("h")).alias("stored"))
