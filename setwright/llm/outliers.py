"""Quality rules: plain counts per document, and robust multivariate outliers among them.

DataFrame and SQL functions only. Counts are taken inside the row, without a shuffle. Documents that
pass the base rules are then compared with others of their language and source: their
transformed statistics form a vector, the minimum-covariance-determinant estimate gives the centre and
covariance of the densest share of the group, and vectors too far away in Mahalanobis distance are rejected.

**Estimate.** Statistics are measured from the group's median in units of its quartile range. Four starts are made from
that alone: the plain units, the covariance of directions (spatial signs), that of ``tanh``, and that of the central box. Each is
concentrated twice: distances to the estimate, the ``SUPPORT`` share of nearest rows, their mean and covariance. The
start with the least determinant goes on until its determinant falls no further; of each step the lower
determinant is kept. One step is one pass with sums per group, start and narrow cell of distances, combined before the shuffle. The cell
that the share ends in counts with the part of it that is needed. Statistics are rounded to thousandths as integers, so
sums are exact and nothing depends on the order of rows; a group of any size sends no more than its cells.

**Statistics without spread.** Where the middle half of a group has one value, any estimate of the nearest rows is singular in it. Such
a statistic is left out of the estimate and judged by itself. Its unit is the spread that departures of their frequency make (the square
root of the share of rows that depart, times their median departure), and no less than what a single occurrence
makes in a document of the group's median length.

**Small groups.** The estimate of a group is drawn to that of its language, and this to that of all documents: with ``n``
documents it weighs ``n / (n + PRIOR)``. That holds for every group alike, so no rule sets in at some size.

Defined results: null texts have no words and fail the base rules; null languages and sources are
groups of their own; ``distance2`` is null only in a table without any document that passes the base rules;
repeated rows get equal rows. A text of any length is counted inside its row. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setwright.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast
from setwright.session import staged

SUPPORT = 0.75
#: Steps that every start gets, and steps at most for the best one.
FIRST_STEPS, MOST_STEPS = 2, 30
#: A determinant that falls by a smaller share has come to rest.
AT_REST = 1e-6
#: Documents that the estimate of the larger group counts for: ten for each statistic.
PRIOR = 50
#: A clean, normally distributed vector is rejected with this probability.
TAIL = 1e-3
P = 5
_STARTS = 4
_CELLS_PER_DOUBLING = 256
_RIDGE = 1e-9
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts of every whole text, and whether the base rules reject it."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    trimmed = F.trim(t, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACE, "") != "")
    per_words = F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _with_words(w).cast("bigint").alias("n_repeat_words")),
    )[0]
    per_lines = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    counted = docs.select(
        docs[key].alias(key),
        *[docs[c].alias(c) for c in keep],
        per_words.alias("_w"),
        F.char_length(F.translate(t, _SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        per_lines.cast("bigint").alias("n_dup_lines"),
    )
    n, r = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return counted.select(
        key, *keep, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
        ((n < 10) | (100 * r > 20 * n)).alias("base_failed"),
    )


def _with_words(w: Column) -> Column:
    """Words inside any window of five that occurs twice or more."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))

    def of_windows(hs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hs) - 5)
        windows = F.when(F.size(hs) < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(5)]))
        )
        return F.transform(F.array(windows), of_repeats)[0]

    def of_repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.transform(F.array(pairs), of_sorted)[0])

    def of_sorted(s: Column) -> Column:
        same = lambda v, k: F.coalesce(F.get(s, k - 1)["x"] == v["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == v["x"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, same), lambda v: v["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("reached")),
            lambda a, i: F.struct((a["total"] + i + 5 - F.greatest(i, a["reached"])).alias("total"), (i + 5).alias("reached")),
            lambda a: a["total"],
        )

    return F.transform(F.array(hashes), of_windows)[0]


def vector() -> list[Column]:
    """The transformed statistics, in thousandths."""
    n, c = F.col("n_words"), F.col("word_chars")
    shares = (
        F.log(F.greatest(c, F.lit(1)) / F.greatest(n, F.lit(1))),
        F.log(1 + 100 * F.col("n_symbols") / F.greatest(c, F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(n, F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
        F.log(F.greatest(n, F.lit(1)).cast("double")),
    )
    return [F.round(1000 * x).cast("bigint").alias(f"x{j}") for j, x in enumerate(shares)]


def chi2_cdf(x: float, p: float) -> float:
    """Share of a chi-squared distribution with ``p`` degrees of freedom below ``x``."""
    a, h = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(q: float, p: float) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def _levels(good: DataFrame, group: list[str]) -> DataFrame:
    """Each row once in its group, and once in each larger one, down to the group of all rows.

    The larger groups have ``_level`` above 0, and null in the columns that they do without.
    """
    kinds = {g: good.schema[g].dataType for g in group}
    at = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("_level"), *[(F.col(g) if j < len(group) - k else F.lit(None).cast(kinds[g])).alias(f"_{g}") for j, g in enumerate(group)])
                for k in range(len(group) + 1)
            ]
        )
    )
    each = good.select(*[f"x{i}" for i in range(P)], at.alias("_at"))
    return each.select(F.col("_at._level").alias("_level"), *[F.col(f"_at._{g}").alias(g) for g in group], *[f"x{i}" for i in range(P)])


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _at(rows: DataFrame, table: DataFrame, group: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Rows with the columns of their group's row of ``table``; null is a group. ``few`` groups, as measured, are broadcast."""
    side = table.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[c for c in table.columns if c not in group])
    same = F.lit(True)
    for g in group:
        same = same & rows[g].eqNullSafe(side[f"_g_{g}"])
    return rows.join(F.broadcast(side) if few else side, same, how).drop(*[f"_g_{g}" for g in group])


def _scales(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group ``all``, and per statistic the median ``mid``, the unit ``unit`` and whether it is ``flat``.

    From counts of the rounded values: as many rows per group and statistic as it has distinct values.
    """
    one = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("x")) for j in range(P)]))
    counts = staged(rows.select(*group, one.alias("v")).select(*group, "v.*").groupBy(*group, "j", "x").agg(F.count(F.lit(1)).alias("n")), "values")

    def quantiles(table: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
        each = Window.partitionBy(*group, "j")
        ranked = table.select(*group, "j", value, F.sum("n").over(each.orderBy(value)).alias("below"), F.sum("n").over(each).alias("all"))
        at = [F.min(F.when(F.col("below") >= q * F.col("all"), F.col(value))).alias(name) for name, q in shares.items()]
        return ranked.groupBy(*group, "j").agg(F.max("all").alias("all"), *at)

    middle = staged(quantiles(counts, "x", {"low": 0.25, "mid": 0.5, "high": 0.75}), "middle")
    apart = _at(counts, middle.drop("all"), [*group, "j"]).withColumn("gone", F.abs(F.col("x") - F.col("mid"))).filter("gone > 0")
    # Two values may lie as far away on either side.
    apart = apart.groupBy(*group, "j", "gone").agg(F.sum("n").alias("n"))
    departure = quantiles(apart, "gone", {"departure": 0.5}).withColumnRenamed("all", "departing")
    by = _at(middle, departure, [*group, "j"], "left")
    flat = F.col("low") == F.col("high")
    spread = F.coalesce(F.sqrt(F.col("departing") / F.col("all")) * F.col("departure"), F.lit(0.0))
    unit = F.when(flat, spread).otherwise((F.col("high") - F.col("low")) / 1.349)
    of = lambda j, c: F.max(F.when(F.col("j") == j, c))
    wide = [x for j in range(P) for x in (of(j, F.col("mid")).alias(f"mid{j}"), of(j, unit).alias(f"unit{j}"), of(j, flat).alias(f"flat{j}"))]
    found = by.groupBy(*group).agg(F.max("all").alias("all"), *wide)
    words = F.exp(F.col("mid4") / 1000)
    chars = words * F.exp(F.col("mid0") / 1000)
    once = (F.log(1 + 1 / chars), F.log(1 + 100 / chars), F.sqrt(1 / words), F.sqrt(1 / words), F.log(1 + 1 / words))
    return staged(found.withColumns({f"unit{j}": F.when(F.col(f"flat{j}"), F.greatest(f"unit{j}", 1000 * once[j])).otherwise(F.col(f"unit{j}")) for j in range(P)}), "scales")


def _z(j: int) -> Column:
    """A statistic in units of its group; 0 if it has no spread there."""
    return F.when(F.col(f"flat{j}"), F.lit(0.0)).otherwise((F.col(f"x{j}") - F.col(f"mid{j}")) / F.col(f"unit{j}"))


def _factored(table: DataFrame, diagonal: float) -> DataFrame:
    """Add the Cholesky factor ``l`` of the covariances ``c``, and the determinant."""
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}") + (diagonal if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(diagonal * 1e-3))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return table.withColumn("det", det)


def _model(sums: DataFrame, n: Column, total, product, keys: list[str], scales: DataFrame, group: list[str]) -> DataFrame:
    """Mean ``m`` and covariance ``c`` in units of the group, from sums; 0 and 1 for statistics without spread."""
    either = lambda i, j: F.col(f"flat{i}") | F.col(f"flat{j}")
    met = _at(sums, scales, group)
    means = [F.when(F.col(f"flat{i}"), F.lit(0.0)).otherwise(total(i) / n).alias(f"m{i}") for i in range(P)]
    cov = [
        F.when(either(i, j), F.lit(1.0 if i == j else 0.0)).otherwise(product(i, j) / n - total(i) / n * (total(j) / n)).alias(f"c{i}{j}") for i, j in _PAIRS
    ]
    return staged(_factored(met.select(*keys, *means, *cov), _RIDGE), "estimate")


def _starts(rows: DataFrame, scales: DataFrame, group: list[str], few: bool) -> DataFrame:
    """Four first estimates per group, all centred at the median."""
    z = [f"z{j}" for j in range(P)]
    measured = _at(rows, scales, group, few=few).select(*group, *[_z(j).alias(f"z{j}") for j in range(P)])
    length = F.sqrt(sum((F.col(x) * F.col(x) for x in z[1:]), F.col(z[0]) * F.col(z[0])))
    inside = F.greatest(*[F.abs(F.col(x)) for x in z]) <= 2
    kinds = {
        1: [F.when(length > 0, F.col(x) / length).otherwise(F.lit(0.0)) for x in z],
        2: [F.tanh(F.col(x)) for x in z],
        3: [F.when(inside, F.col(x)).otherwise(F.lit(0.0)) for x in z],
    }
    # Rounded to millionths, so that sums are exact.
    whole = lambda c: F.sum(F.round(1e6 * c).cast("bigint")) / 1e6
    sums = [whole(v[i] * v[j]).alias(f"k{k}_{i}{j}") for k, v in kinds.items() for i, j in _PAIRS]
    found = measured.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"), *sums)
    size = {1: F.col("n"), 2: F.col("n"), 3: F.greatest("n_inside", F.lit(1))}

    def entry(k: int, i: int, j: int) -> Column:
        return F.lit(1.0 if i == j else 0.0) if k == 0 else F.col(f"k{k}_{i}{j}") / size[k]

    each = [F.struct(F.lit(k).alias("start"), *[entry(k, i, j).cast("double").alias(f"p{i}{j}") for i, j in _PAIRS]) for k in range(_STARTS)]
    flat = found.select(*group, F.explode(F.array(*each)).alias("s")).select(*group, "s.*")
    return _model(flat, F.lit(1.0), lambda i: F.lit(0.0), lambda i, j: F.col(f"p{i}{j}"), [*group, "start"], scales, group)


def _concentrated(rows: DataFrame, model: DataFrame, scales: DataFrame, group: list[str], few: bool) -> DataFrame:
    """One step from each estimate of ``model``: that of the nearest ``SUPPORT`` share of its group."""
    numbers = model.select(*group, "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS])
    met = _at(_at(rows, scales, group, few=few), numbers, group, few=few)
    for i in range(P):
        rest = _z(i) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        met = met.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    distance = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    cell = F.floor(_CELLS_PER_DOUBLING * F.log2(1 + distance)).cast("int")
    names = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]]
    off = lambda i: F.col(f"x{i}") - F.col(f"mid{i}")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(off(i)).alias(f"s{i}") for i in range(P)], *[F.sum(off(i) * off(j)).alias(f"s{i}{j}") for i, j in _PAIRS]]
    keys = [*group, "start"]
    cells = met.groupBy(*keys, cell.alias("cell")).agg(F.max("all").alias("all"), *sums)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.least(F.col("all"), F.greatest(F.ceil(SUPPORT * F.col("all")), F.floor((F.col("all") + P + 1) / 2)))
    near = cells.select("*", before.alias("before"), share.alias("share")).filter(F.col("before") < F.col("share"))
    # Whole cells are added up as integers; the last one counts with the part that is needed.
    last = F.col("before") + F.col("n") > F.col("share")
    parts = near.groupBy(*keys).agg(
        F.max("share").alias("share"), F.max(F.when(last, (F.col("share") - F.col("before")) / F.col("n"))).alias("part"),
        *[x for c in names for x in (F.sum(F.when(~last, F.col(c))).alias(f"{c}_in"), F.max(F.when(last, F.struct(c))).alias(f"{c}_at"))],
    )
    both = lambda c: F.coalesce(F.col(f"{c}_in"), F.lit(0)) + F.coalesce(F.col("part") * F.col(f"{c}_at.{c}"), F.lit(0.0))
    total = lambda i: both(f"s{i}") / F.col(f"unit{i}")
    product = lambda i, j: both(f"s{i}{j}") / (F.col(f"unit{i}") * F.col(f"unit{j}"))
    return _model(parts, F.col("share").cast("double"), total, product, keys, scales, group)


def mcd(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The estimate of each group in its own units (``m``, ``c``, ``det``), and the units (see ``_scales``).

    ``rows`` has the statistics ``x0`` .. as integers.
    """
    scales = _scales(rows, group)
    # An estimate has four rows a group, twice as long as the units.
    few = fits_broadcast(scales, BROADCAST_ROWS // 8, BROADCAST_BYTES // 8)
    model = _starts(rows, scales, group, few)
    for _ in range(FIRST_STEPS):
        model = _concentrated(rows, model, scales, group, few)
    numbers = [c for c in model.columns if c not in (*group, "start")]
    best = model.groupBy(*group).agg(F.min(F.struct("det", "start", *[c for c in numbers if c != "det"])).alias("b"))
    state = staged(best.select(*group, F.col("b.start").alias("start"), *[F.col(f"b.{c}").alias(c) for c in numbers], F.lit(True).alias("live")), "state")
    for _ in range(MOST_STEPS):
        live = state.filter("live")
        if live.isEmpty():
            break
        new = _concentrated(rows, live, scales, group, few).select(*group, F.struct(*numbers).alias("new"))
        met = _at(state, new, group, "left")
        lower = F.coalesce(F.col("new.det") < F.col("det") * (1 - AT_REST), F.lit(False))
        state = staged(
            met.select(*group, "start", *[F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in numbers], lower.alias("live")), "state"
        )
    return state.drop("live"), scales


def _estimates(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group ``all``, mean ``a`` and covariance ``v`` in thousandths, consistent for a normal whole."""
    model, scales = mcd(rows, group)
    met = _at(model, scales, group)
    live = sum(((~F.col(f"flat{i}")).cast("int") for i in range(1, P)), (~F.col("flat0")).cast("int"))
    # The nearest share alone spreads less than all; this makes its covariance that of a normal whole.
    factors = [1.0] + [SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, k), k + 2) for k in range(1, P + 1)]
    factor = F.get(F.array(*map(F.lit, factors)), live)
    means = [(F.col(f"mid{i}") + F.col(f"m{i}") * F.col(f"unit{i}")).alias(f"a{i}") for i in range(P)]
    # A statistic without spread has the covariance 1 with itself in its own units.
    own = lambda i, j: F.when(F.col(f"flat{i}") | F.col(f"flat{j}"), F.lit(1.0)).otherwise(factor)
    cov = [(F.col(f"c{i}{j}") * F.col(f"unit{i}") * F.col(f"unit{j}") * own(i, j)).alias(f"v{i}{j}") for i, j in _PAIRS]
    return met.select(*group, F.col("all").cast("double").alias("all"), *means, *cov)


def _drawn(groups: DataFrame, estimates: DataFrame, group: list[str]) -> DataFrame:
    """The estimate of every one of ``groups``, drawn to that of the next larger group, and so on up to all rows."""
    numbers = [f"a{i}" for i in range(P)] + [f"v{i}{j}" for i, j in _PAIRS]
    estimates = staged(estimates, "estimates")
    top = estimates.filter(F.col("_level") == len(group)).select(F.struct(*numbers).alias("up"))
    # One row for all documents.
    out = groups.join(F.broadcast(top), F.lit(True), "left").select(
        *group, *[(F.col(f"up.{c}") + (1.0 if c[0] == "v" and c[1] == c[2] else 0.0)).alias(c) for c in numbers]
    )
    for k in reversed(range(len(group))):
        keys = group[: len(group) - k]
        own = estimates.filter(F.col("_level") == k).select(*keys, F.col("all"), F.struct(*numbers).alias("own"))
        weight = F.col("all") / (F.col("all") + PRIOR)
        mixed = [F.when(F.col("all").isNull(), F.col(c)).otherwise(weight * F.col(f"own.{c}") + (1 - weight) * F.col(c)).alias(c) for c in numbers]
        out = _at(out, own, keys, "left").select(*group, *mixed)
    return staged(_factored(out.select(*group, *[f"a{i}" for i in range(P)], *[F.col(f"v{i}{j}").alias(f"c{i}{j}") for i, j in _PAIRS]), _RIDGE), "mcd")


def _distance(rows: DataFrame, model: DataFrame, group: list[str]) -> DataFrame:
    """Add the squared Mahalanobis distance; null where there is no estimate."""
    joined = _at(rows, model, group, "left")
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"a{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    return joined.select(*rows.columns, total.alias("distance2"))


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    group: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``distance2`` and ``kept``."""
    group = list(group)
    counts = staged(text_counts(docs, key, text, tuple(group)), "text_counts")
    rows = counts.select("*", *vector())
    good = staged(_levels(rows.filter("NOT base_failed"), group), "vectors")
    model = _drawn(rows.select(*group).distinct(), _estimates(good, ["_level", *group]), group)
    judged = _distance(rows, model, group)
    far = F.coalesce(F.col("distance2") > chi2_quantile(1 - TAIL, P), F.lit(False))
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), F.col("distance2"),
    )
