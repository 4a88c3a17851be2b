"""Exact quantiles and row numbers without a key's rows in one task.

Quantiles are found by counting: a pass counts the values between the smallest and the
largest in equal bins, and the bin that holds a rank is counted again, until few
values are left.  Only counts leave a task.

Row numbers come from ranges of the order: a range's rows are numbered by themselves and
start where the rows of the ranges before it end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a pass, and values that may be sorted at last for each rank.
BINS = 1024
FEW = 1000
#: Rows of a range of the order, and ranges at most.
SPAN = 100_000
RANGES = 10_000


def magnitude(v: Column) -> Column:
    """A number between -1460 and 1460 that rises with v as its logarithm does, on either side of 0."""
    size = F.least(F.ln(F.abs(v)) + 746, F.lit(1460.0))
    return F.when(v == 0, 0.0).when(v > 0, size).otherwise(-size)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """key, n, low, high, mean and ``quantiles``: the interpolated quantile of each share, one row for each value of ``by`` (a few values).

    Null and NaN values are left out; a key without any other has no row.  The driver
    gets at most ``bins`` counts for each key and rank, and ``few`` values at last.
    """
    spark = df.sparkSession
    rows = df.select(F.lit("").alias("key") if by is None else F.col(by).cast("string").alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean")).collect()
    found: dict[tuple, float] = {}
    open_: dict[tuple, list] = {}  # (key, rank): values below, low, high, values inside
    for r in stats:
        for share in shares:
            for rank in {math.floor(share * (r["n"] - 1)), math.ceil(share * (r["n"] - 1))}:
                open_[r["key"], rank] = [0, r["low"], r["high"], r["n"]]

    def inside() -> DataFrame:
        """The values within each open interval, whatever the number of ranks that share it."""
        intervals = sorted({(key, x[1], x[2]) for (key, _), x in open_.items()}, key=repr)
        table = spark.createDataFrame(intervals, "key string, a double, z double")
        return rows.join(F.broadcast(table.withColumnRenamed("key", "of")), F.col("key").eqNullSafe(F.col("of")) & F.col("v").between(F.col("a"), F.col("z"))).select("key", "a", "z", "v")

    passes = 0
    while open_:
        for k in [k for k, x in open_.items() if x[1] == x[2]]:
            found[k] = open_.pop(k)[1]
        if not open_ or max(x[3] for x in open_.values()) <= few:
            break
        # equal bins of the values, and by turns of their magnitudes: neither many orders of size nor a far outlier takes many passes
        half = lambda c: F.col(c) / 2  # noqa: E731  a difference may be too large for a double
        size = lambda c: magnitude(F.col(c))
        share = lambda f: F.try_divide(f("v") - f("a"), f("z") - f("a"))
        linear = (F.abs("a") < float("inf")) & (F.abs("z") < float("inf")) & F.lit(passes % 2 == 0)
        part = F.coalesce(F.least(F.floor(F.when(linear, share(half)).otherwise(share(size)) * bins), F.lit(bins - 1)), F.lit(0))
        passes += 1
        counts: dict[tuple, list] = {}
        for r in inside().groupBy("key", "a", "z", part.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            counts.setdefault((r["key"], r["a"], r["z"]), []).append((r["bin"], r["n"], r["low"], r["high"]))
        for (key, rank), x in open_.items():
            below = x[0]
            for _, n, low, high in sorted(counts[key, x[1], x[2]]):
                if below + n > rank:
                    break
                below += n
            x[:] = below, low, high, n
    if open_:
        values: dict[tuple, list] = {}
        for r in inside().collect():
            values.setdefault((r["key"], r["a"], r["z"]), []).append(r["v"])
        for (key, rank), x in open_.items():
            found[key, rank] = sorted(values[key, x[1], x[2]])[rank - x[0]]

    def quantile(key: str, n: int, share: float) -> float:
        place = share * (n - 1)
        a, z = found[key, math.floor(place)], found[key, math.ceil(place)]
        return a + (z - a) * (place - math.floor(place))

    made = [(r["key"], r["n"], r["low"], r["high"], r["mean"], [quantile(r["key"], r["n"], s) for s in shares]) for r in stats]
    return spark.createDataFrame(made, "key string, n long, low double, high double, mean double, quantiles array<double>")


def as_number(df: DataFrame, order: str) -> Column:
    """A double that rises with a column of numbers, dates or times; times without a zone are taken as they stand."""
    kind, c = dict(df.dtypes)[order], F.col(order)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind != "timestamp_ntz":
        return c.cast("double")
    since = c - F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    parts = [F.date_part(F.lit(unit), since).cast("double") * n for unit, n in seconds.items()]
    return parts[0] + parts[1] + parts[2] + parts[3]


def range_of(df: DataFrame, order: str, span: int = SPAN) -> Column | None:
    """The number of the range that a row's place in the order falls in; ranges hold about ``span`` rows of the table.

    Bounds are drawn once, so that every use of the column cuts alike.  None where one range holds all.
    """
    n = df.count()
    wanted = min(RANGES, -(-n // span))
    if wanted <= 1:
        return None
    numeric = as_number(df, order)
    drawn = df.agg(F.percentile_approx(numeric, [k / wanted for k in range(1, wanted)], max(1000, 5 * wanted))).first()[0]
    bounds = sorted({b for b in drawn or () if b is not None})
    step = max(1, math.isqrt(len(bounds)))
    heads = bounds[::step]
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    passed = lambda xs, v: F.size(F.filter(xs, lambda b: b <= v))
    groups = F.array(*[doubles(bounds[k : k + step]) for k in range(0, len(bounds), step)])
    # two steps: the group of bounds, then the bound within it; nulls come first
    within = lambda v, g: F.when(g == 0, 0).otherwise((g - 1) * step + passed(F.get(groups, g - 1), v))
    # arrays of one, so that the number and the group are found once for all bounds
    found = F.transform(F.array(numeric), lambda v: F.transform(F.array(passed(doubles(heads), v)), lambda g: within(v, g))[0])[0]
    return F.when(numeric.isNull(), 0).otherwise(found)


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "n", span: int = SPAN) -> DataFrame:
    """Adds the number of each row, from 1, among the rows of its key in the order, whose first column is a number or a time.

    A key's rows are numbered range by range, so no task holds a hot key.  Ties of
    the whole order get different numbers in any order; null comes first.
    """
    if dict(df.dtypes)[order[0]] in ("string", "binary", "boolean"):
        raise ValueError("the first column of the order is a number or a time")
    part = range_of(df, order[0], span)
    if part is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    cut = df.withColumn("__part", part)
    sizes = cut.groupBy(*by, "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    own = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__part") == F.col("__of")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return own.join(starts, condition).withColumn(name, (F.col("__n") + F.col("__before")).cast("long")).select(*df.columns, name)


def with_last(log: DataFrame, column: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``column`` of the revision before, by id and seq; null on an id's first one.

    Windows are over ranges of ``span`` numbers within an id.  The last row of a range is carried
    to the id's next range as a row of its own; only ids with more than one range have any,
    and these rows are few: one in ``span``.  Numbers may have gaps.
    """
    cut = log.withColumn("__part", F.floor((F.col("seq") - 1) / span)).withColumn("__carried", F.lit(False))
    rows = cut.select("id", "__part", "seq", column).groupBy("id", "__part").agg(F.max_by(F.struct("seq", column), "seq").alias("__row"))
    several = cut.where("__part > 0").select("id").distinct()
    ends = rows.join(several, "id", "left_semi").withColumn("__next", F.lead("__part").over(Window.partitionBy("id").orderBy("__part"))).where("__next is not null")
    empty = [F.lit(None).cast(t).alias(c) for c, t in log.dtypes if c not in ("id", "seq", column)]
    carried = ends.select("id", F.col("__row.seq").alias("seq"), F.col(f"__row.{column}").alias(column), *empty, F.col("__next").alias("__part"), F.lit(True).alias("__carried"))
    every = cut.unionByName(carried)
    led = every.withColumn(name, F.lag(column).over(Window.partitionBy("id", "__part").orderBy("seq")))
    return led.where("not __carried").drop("__part", "__carried")
