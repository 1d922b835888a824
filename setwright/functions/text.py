"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_hex(c: Column | str) -> Column:
    """MD5 of text (as UTF-8) or of bytes, in lower-case hex."""
    return F.md5(_col(c))


def replace_all(c: Column | str, search: str, replacement: Column | str) -> Column:
    """Replace every occurrence of the literal ``search``."""
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.replace(_col(c), F.lit(search), new)


def split_tokens(c: Column | str, delimiter: str) -> Column:
    """Split on one character; a trailing delimiter opens no token, '' gives []."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    parts = F.split(_col(c), re.escape(delimiter), -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def ends_with(c: Column | str, suffix: str) -> Column:
    return _col(c).endswith(suffix)


def join_tokens(tokens: Column | str, delimiter: str = ", ") -> Column:
    """Join an array; no delimiter is put while the output is still empty."""
    tokens = F.transform(_col(tokens), lambda t: F.coalesce(t, F.lit("")))
    first = F.array_position(F.transform(tokens, lambda t: t != ""), F.lit(True))
    return F.when(
        first > 0, F.array_join(F.slice(tokens, first.cast("int"), F.size(tokens)), delimiter)
    ).otherwise("")


def join_fields(fields: Sequence[Column], delimiter: str = " ") -> Column:
    """``join_tokens`` over a fixed list of columns.

    Leading empty fields contribute nothing, later ones leave their delimiter.
    The joined text starts with one delimiter per leading empty field, so these
    are cut by position; this keeps the expression linear and code-generated.
    """
    filled = [F.coalesce(f, F.lit("")) for f in fields]
    leading = F.lit(len(filled))
    for i in reversed(range(len(filled))):
        leading = F.when(filled[i] != "", F.lit(i)).otherwise(leading)
    joined = F.concat_ws(delimiter, *filled)
    return F.substr(joined, leading * len(delimiter) + 1)


def key_values(c: Column | str) -> Column:
    """``k=v;k=v`` to a map: the first of equal keys wins, a value ends at the next '='."""
    pairs = F.transform(
        split_tokens(c, ";"),
        lambda p: F.struct(
            F.get(F.split(p, "="), F.lit(0)).alias("key"),
            F.coalesce(F.get(F.split(p, "="), F.lit(1)), F.lit("")).alias("value"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(
        F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    )


def quoted(c: Column | str) -> Column:
    """The value between double quotes, not escaped."""
    return F.concat(F.lit('"'), F.coalesce(_col(c), F.lit("")), F.lit('"'))


def int_text(c: Column | str) -> Column:
    return _col(c).cast("string")


def _large_text(size: Column) -> Column:
    """Every digit of a single-precision value from 2**62 on.

    Such a value is ``a * 2**b`` with a small ``a``, so taking the power of two
    out is exact. Above 38 digits the product is made in two halves.
    """
    unit = 2**78
    high, low = divmod(unit, 10**12)
    a = (size / float(unit)).cast("bigint").cast("decimal(16,0)")
    tail = a * F.lit(Decimal(low))
    head = (a * F.lit(Decimal(high)) + F.floor(tail / F.lit(Decimal(10**12)))).cast("decimal(38,0)")
    halves = F.concat(
        head.cast("string"), F.lpad((tail % F.lit(Decimal(10**12))).cast("decimal(12,0)").cast("string"), 12, "0")
    )
    product = (size / float(2**39)).cast("bigint").cast("decimal(19,0)") * F.lit(Decimal(2**39))
    return F.when(size < float(2**101), product.cast("string")).otherwise(halves)


def float_text(c: Column | str) -> Column:
    """A single-precision value with six decimals, as C's ``%f`` prints it.

    A 24-bit number times a million still fits a double exactly, so rounding it
    half to even decides ties on the exact binary value.
    """
    single = _col(c).cast("float")
    size = F.abs(single.cast("double"))
    # Negative zero keeps its sign; only zeros are printed to see it.
    negative_zero = (single == 0) & F.startswith(single.cast("string"), F.lit("-"))
    sign = F.when((single < 0) | negative_zero, "-").otherwise("")
    micros = F.rint(size * 1e6).cast("bigint")
    whole = F.floor(micros / 1e6).cast("string")
    fraction = F.lpad((micros % 1_000_000).cast("string"), 6, "0")
    # The rare case is kept out of the generated code by the array around it.
    large = F.get(F.transform(F.array(size), _large_text), F.lit(0))
    return (
        F.when(size < 1e9, F.concat(sign, whole, F.lit("."), fraction))
        .when(F.isnan(single), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size < float(2**62), F.concat(sign, size.cast("bigint").cast("string"), F.lit(".000000")))
        .otherwise(F.concat(sign, large, F.lit(".000000")))
    )


def is_hash_text(c: Column | str) -> Column:
    """Whether the text can be stored as bytes: hex digits, an even number of them."""
    c = _col(c)
    return F.coalesce((F.length(c) > 0) & (F.length(c) % 2 == 0) & c.rlike("^[0-9a-fA-F]*$"), F.lit(False))


def hex_to_bytes(c: Column | str) -> Column:
    """Hex text to bytes; NULL where the text is not valid hash text."""
    return F.when(is_hash_text(c), F.try_to_binary(_col(c), F.lit("hex")))


def bytes_to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(_col(c)))


def base_name(c: Column | str) -> Column:
    """The part of a file name before its first dot."""
    return F.substring_index(_col(c), ".", 1)


def set_of_shard(c: Column | str, extension: str = "h5") -> Column:
    """``train12.h5`` to ``train``."""
    return F.regexp_replace(_col(c), r"[0-9]*\." + re.escape(extension), "")


def default_filename(url: Column | str, dtype: Column | str) -> Column:
    """The name of an asset that came without one: md5 of its URL and a suffix by dtype."""
    dtype = _col(dtype)
    suffix = F.when(dtype == "jpeg", ".jpg").when(dtype == "png", ".png").otherwise("")
    return F.concat(F.md5(F.coalesce(_col(url), F.lit(""))), suffix)


def blob_path(filename: Column | str, root: str = "", tree: bool = True) -> Column:
    """Where a blob is kept: below ``data/``, under three one-letter folders.

    Names of seven characters or fewer are kept flat, as is everything with
    ``tree=False``.
    """
    filename = _col(filename)
    flat = F.concat(F.lit(f"{root}data/"), filename)
    if not tree:
        return flat
    nested = F.concat_ws(
        "/",
        F.lit(f"{root}data"),
        F.substring(filename, 1, 1),
        F.substring(filename, 2, 1),
        F.substring(filename, 3, 1),
        filename,
    )
    return F.when(F.length(filename) > 7, nested).otherwise(flat)


def name_matches_content(filename: Column | str, content: Column | str) -> Column:
    """Whether a content-addressed file name is the MD5 of what it names."""
    return base_name(filename) == F.md5(_col(content))


def page_url(template: Column | str, size: Column, offset: Column, iteration: Column) -> Column:
    """Fill the page variables of a feed address."""
    url = _col(template)
    for name, value in (("$BATCHSIZE", size), ("$OFFSET", offset), ("$ITERATION", iteration)):
        url = replace_all(url, name, value.cast("string"))
    return url
