"""The record feed: pages of JSON records to typed rows, bad ones kept with a reason.

A page is parsed once to an array of VARIANTs, one for each record; everything after
that reads members of them inside the row. No step
shuffles. Of a repeated key the last value counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright import schema
from setwright.functions.text import default_filename, page_url
from setwright.sources.job import Field


def read_pages(spark: SparkSession, path: str, one_page_per: str = "file") -> DataFrame:
    """Feed pages as ``(page_file, body)``: one per file, or one per line."""
    if one_page_per not in ("file", "line"):
        raise ValueError("one_page_per is 'file' or 'line'")
    text = spark.read.text(path, wholetext=one_page_per == "file")
    return text.select(F.col("_metadata.file_path").alias("page_file"), F.col("value").alias("body"))


def page_plan(count: Column, size: int, template: Column, iteration: Column) -> Column:
    """The pages that cover ``count`` records, as ``array<struct<batch, url>>``."""
    batches = F.ceil(count / size)
    return F.transform(
        F.when(batches > 0, F.sequence(F.lit(0).cast("bigint"), batches - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
        lambda b: F.struct(
            b.alias("batch"),
            page_url(template, F.lit(size), b * size, iteration).alias("url"),
        ),
    )


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    """The type name of a scalar member."""
    return F.schema_of_variant(v)


def _text(members: Column, key: str) -> Column:
    """A member that must be a JSON string; NULL otherwise."""
    member = F.try_element_at(members, F.lit(key))
    return F.when(_kind(member) == "STRING", F.try_variant_get(member, "$", "string"))


def _int(members: Column, key: str) -> Column:
    """A member that must be a whole JSON number of 32 bits; NULL otherwise."""
    member = F.try_element_at(members, F.lit(key))
    return F.when(_kind(member) == "BIGINT", F.try_variant_get(member, "$", "int"))


def _float(members: Column, key: str) -> Column:
    member = F.try_element_at(members, F.lit(key))
    return F.when(
        _kind(member).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"),
        F.try_variant_get(member, "$", "float"),
    )


# A record that is an object but too large for a VARIANT (128 MiB); it fails itself only.
_UNREADABLE = "unreadable_record"
_VARIANT_BYTES = 128 * 1024 * 1024
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def _checked_pages(pages: DataFrame) -> DataFrame:
    """Parse each page's records once; keep their members and what is wrong with them.

    Each record is a VARIANT of its own, so its kind is that of the page: a string that holds an object is a
    string. A record, not a page, has to fit a VARIANT. Pages large enough to hold one that does not are split to the
    texts of their records if they cannot be parsed, and those are read one by one.
    """
    # Read when a plan is optimized, so it stays set.
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keep = [c for c in pages.columns if c != "body"]
    # One more pair of brackets shows text after the array, which a parser drops.
    bracketed = F.when(F.col("body").rlike(r"^\s*\["), F.concat(F.lit("["), F.col("body"), F.lit("]")))

    def parsed(kind: str) -> Column:
        return F.from_json(bracketed, f"array<array<{kind}>>", _ANY_LENGTH)

    large = (F.octet_length("body") >= _VARIANT_BYTES) & F.col("_outer").isNull()
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))

    def read(record: Column) -> Column:
        return F.struct(_object(record).alias("m"), F.lit(False).alias("o"))

    def read_text(text: Column) -> Column:
        return F.struct(_object(F.try_parse_json(text)).alias("m"), F.coalesce(text.startswith("{"), F.lit(False)).alias("o"))

    def defect(record: Column) -> Column:
        allowed = F.array(*map(F.lit, schema.RECORD_KEYS))
        members = record["m"]
        return (
            F.when(members.isNull() & record["o"], _UNREADABLE)
            .when(members.isNull(), "not_an_object")
            .when(F.size(F.array_except(F.map_keys(members), allowed)) > 0, "unknown_key")
        )

    return (
        pages.select(*keep, "body", parsed("variant").alias("_outer"))
        .select(*keep, only("_outer").alias("_elements"), F.when(large, parsed("string")).alias("_texts"))
        .select(*keep, "_elements", only("_texts").alias("_texts"))
        .select(
            *keep,
            F.coalesce(F.transform("_elements", lambda e: read(e)), F.transform("_texts", lambda e: read_text(e))).alias("_read"),
        )
        .select(
            *keep,
            F.transform("_read", lambda r: r["m"]).alias("_members"),
            F.transform("_read", lambda r: defect(r)).alias("_defects"),
        )
        .withColumn(
            "_page_defect",
            F.when(F.col("_members").isNull(), "not_an_array").otherwise(
                F.get(F.filter("_defects", lambda d: d != _UNREADABLE), F.lit(0))
            ),
        )
    )


def page_status(pages: DataFrame) -> DataFrame:
    """Per page, whether all of it can be used and the first reason if not."""
    keep = [c for c in pages.columns if c != "body"]
    return _checked_pages(pages).select(
        *keep, F.col("_page_defect").isNull().alias("ok"), F.col("_page_defect").alias("reason")
    )


def parse_records(pages: DataFrame, strict: str = "page") -> DataFrame:
    """Explode pages (column ``body``) to records.

    Adds ``pos, set, api_hash, data`` and ``reason``; ``reason`` is NULL for a
    good record. A page that is not one JSON array gives one row with a reason.
    A record that is no object, or that has a key beyond set, data and hash,
    fails its whole page, or only itself with ``strict="record"``.
    """
    if strict not in ("page", "record"):
        raise ValueError("strict is 'page' or 'record'")
    keep = [c for c in pages.columns if c != "body"]
    no_array = F.col("_page_defect") == "not_an_array"
    exploded = _checked_pages(pages).select(
        *keep,
        "_page_defect",
        F.posexplode_outer(F.arrays_zip("_members", "_defects")).alias("pos", "_r"),
    )
    own = F.when(no_array, F.col("_page_defect")).otherwise(F.col("_r._defects"))
    # An empty page opens one row without a position; it holds no record.
    return exploded.filter(no_array | F.col("pos").isNotNull()).select(
        *keep,
        "pos",
        _text(F.col("_r._members"), "set").alias("set"),
        _text(F.col("_r._members"), "hash").alias("api_hash"),
        _array(F.try_element_at(F.col("_r._members"), F.lit("data"))).alias("data"),
        (F.coalesce("_page_defect", own) if strict == "page" else own).alias("reason"),
    )


def _lookup(pairs: Sequence[tuple], key_type: str) -> Column:
    flat = [F.lit(v) for pair in pairs for v in pair]
    return F.create_map(*flat).cast(f"map<{key_type},int>")


def _entry_members(members: Column) -> Column:
    """The members of one entry, each read once, before they are judged."""
    numeric = _text(members, "type") == schema.NUMERIC
    optional = F.transform_values(
        F.map_filter(
            members, lambda k, v: ~k.isin(*schema.ENTRY_KEYS) & _array(v).isNotNull()
        ),
        lambda k, v: F.transform(_array(v), lambda e: F.try_variant_get(e, "$", "string")),
    )
    return F.struct(
        _int(members, "id").alias("id"),
        _text(members, "type").alias("type"),
        _text(members, "dtype").alias("dtype"),
        _int(members, "fieldid").alias("field_id"),
        _text(members, "name").alias("field_name"),
        _text(members, "filename").alias("filename"),
        _text(members, "url").alias("url"),
        _int(members, "channels").alias("channels"),
        _int(members, "width").alias("width"),
        _int(members, "height").alias("height"),
        F.coalesce(F.map_contains_key(members, "value"), F.lit(False)).alias("has_value"),
        _text(members, "value").alias("text"),
        F.when(numeric, _int(members, "value")).alias("whole"),
        F.when(numeric, _float(members, "value")).alias("fraction"),
        optional.alias("optional"),
    )


def _entry_struct(m: Column, by_field: Column, by_name: Column) -> Column:
    named = F.try_element_at(by_name, m["field_name"])
    numbered = F.try_element_at(by_field, m["field_id"])
    own_id = F.coalesce(named, numbered, m["id"])
    unknown_field = (m["field_name"].isNotNull() & named.isNull()) | (
        m["field_id"].isNotNull() & numbered.isNull()
    )
    kind, dtype = m["type"], m["dtype"]
    number = m["has_value"] & (kind == schema.NUMERIC)
    int_value = F.when(dtype == "int", m["whole"])
    float_value = F.when(dtype == "float", m["fraction"])
    reason = (
        F.when(kind.isNull(), "missing_type")
        .when(number & dtype.isNull(), "missing_dtype")
        .when(number & ~dtype.isin("int", "float"), "bad_dtype")
        .when(number & F.coalesce(int_value.cast("float"), float_value).isNull(), "bad_value")
        .when(m["has_value"] & ~kind.isin(*schema.SCALAR_TYPES), "value_on_blob")
        .when(unknown_field, "unknown_field")
        .when(own_id.isNull() & (kind != schema.ARCHIVE), "no_output_id")
        .when((m["url"] != "") & kind.isin(*schema.SCALAR_TYPES), "url_on_scalar")
    )
    named_file = F.coalesce(m["filename"], F.lit("")) != ""
    return F.struct(
        own_id.alias("id"),
        *[m[f].alias(f) for f in ("type", "dtype", "field_id", "field_name")],
        F.when(named_file, m["filename"]).otherwise(default_filename(m["url"], dtype)).alias("filename"),
        *[m[f].alias(f) for f in ("url", "channels", "width", "height")],
        F.when(kind == schema.STRING, m["text"]).alias("string_value"),
        int_value.alias("int_value"),
        float_value.alias("float_value"),
        m["optional"].alias("optional"),
        reason.alias("reason"),
        F.lit(None).cast("binary").alias("content"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("bigint").alias("n_bytes"),
    )


def typed_entries(entries: Column, mapping: Sequence[Field]) -> Column:
    """An array of entries (VARIANT objects) to typed structs, each with its reject reason.

    The output id comes from the field name, else the field id, else the id
    given. The mapping is part of the job document, so it is a literal map: the
    lookup is done inside the row and moves nothing. The steps are separate
    transforms so that no member is read twice.
    """
    by_field = _lookup([(f.field_id, f.id) for f in mapping if f.field_id is not None], "int")
    by_name = _lookup([(f.name, f.id) for f in mapping], "string")
    objects = F.transform(entries, lambda e: _object(e))
    members = F.transform(objects, lambda o: _entry_members(o))
    return F.transform(members, lambda m: _entry_struct(m, by_field, by_name))


def parse_entry(entry: Column, mapping: Sequence[Field]) -> Column:
    """One entry (a VARIANT object) to the typed struct."""
    return F.get(typed_entries(F.array(entry), mapping), F.lit(0))


def parse_entries(records: DataFrame, mapping: Sequence[Field]) -> DataFrame:
    """Type the entries of each record; a record with a bad entry gets that entry's reason."""
    keep = [c for c in records.columns if c not in ("data", "reason")]
    typed = records.select(
        *keep,
        "reason",
        F.coalesce(
            typed_entries(F.col("data"), mapping),
            F.array().cast(f"array<{schema.ENTRY}>"),
        ).alias("entries"),
    )
    bad = F.get(
        F.filter(F.transform("entries", lambda e: e["reason"]), lambda r: r.isNotNull()), F.lit(0)
    )
    return typed.select(*keep, "entries", F.coalesce("reason", bad).alias("reason"))


def read_feed(pages: DataFrame, mapping: Sequence[Field], strict: str = "page") -> DataFrame:
    """Pages to typed records: ``set, api_hash, entries, reason`` and the page's columns."""
    return parse_entries(parse_records(pages, strict), mapping)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNull()).drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNotNull())


def random_sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(rows, count)`` random rows: a bounded top-k, never a full sort."""
    return df.orderBy(F.rand(seed)).limit(rows)
