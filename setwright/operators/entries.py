"""Entries of a record to output cells, within the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from setwright import schema
from setwright.functions.text import blob_path, float_text, int_text, join_tokens, quoted
from setwright.sources.job import Field


def is_blob(e: Column) -> Column:
    return e["type"].isin(*schema.BLOB_TYPES)


def escaped(text: Column) -> Column:
    """Backslash escapes for quote, backslash and line breaks."""
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def cell_text(e: Column, root: str, tree: bool, escape: bool = False) -> Column:
    """The text of one entry: a path, a quoted string, or a number."""
    text = escaped(e["string_value"]) if escape else e["string_value"]
    return (
        F.when(is_blob(e), blob_path(e["filename"], root, tree))
        .when(e["type"] == schema.STRING, quoted(text))
        .when(e["dtype"] == "float", float_text(e["float_value"]))
        .when(e["dtype"] == "int", int_text(e["int_value"]))
        .otherwise("")
    )


def output_cells(entries: Column, fields: Sequence[Field], cell) -> Column:
    """The cells of a record in output column order, as an array; a field without entry is ''.

    Of entries with the same id the last counts; numbers are appended. Every
    entry's text is made once: the array of texts is bound to a lambda variable
    and the fields look into it.
    """
    texts = F.transform(
        entries,
        lambda e: F.struct(
            e["id"].alias("id"),
            (e["type"] == schema.NUMERIC).alias("number"),
            F.coalesce(cell(e), F.lit("")).alias("text"),
        ),
    )
    ids = F.array(*[F.lit(f.id) for f in fields])

    def of_field(made: Column, field_id: Column) -> Column:
        return F.aggregate(
            F.filter(made, lambda t: t["id"] == field_id),
            F.lit(""),
            lambda text, t: F.when(t["number"], F.concat(text, t["text"])).otherwise(t["text"]),
        )

    bound = F.transform(F.array(texts), lambda made: F.transform(ids, lambda i: of_field(made, i)))
    return F.get(bound, F.lit(0))


def output_line(entries: Column, fields: Sequence[Field], cell) -> Column:
    """The cells joined by one space; cells that are empty at the start vanish."""
    joined = F.transform(
        F.array(output_cells(entries, fields, cell)), lambda cells: join_tokens(cells, " ")
    )
    return F.get(joined, F.lit(0))


def last_with_id(entries: Column, field_id: Column) -> Column:
    """The last entry with an output id, or NULL."""
    return F.try_element_at(F.filter(entries, lambda e: e["id"] == field_id), F.lit(-1))


def last_of(entries: Column, field: Field) -> Column:
    """The last entry of a field, or NULL."""
    return last_with_id(entries, F.lit(field.id))


def composite_hash(hashes: Column) -> Column:
    """The hashes of a record's entries one after the other, in entry order."""
    return F.array_join(hashes, "")
