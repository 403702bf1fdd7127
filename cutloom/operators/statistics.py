"""Loudness, robust outliers, interaction of sources, novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.levels import FLOOR_DB, lufs, masking_risk
from cutloom.functions.vectors import dot, norm


def integrated_loudness(blocks: DataFrame, by: list[str], energy: str) -> DataFrame:
    """Loudness of energies over two gates: −70 LUFS, then 10 under the mean of what is left: by, loudness."""
    rows = blocks.withColumn("__l", lufs(F.col(energy)))
    first = rows.where("__l >= -70").groupBy(*by).agg(F.avg(energy).alias("__m"))
    kept = rows.join(first, by).where((F.col("__l") >= -70) & (F.col("__l") >= lufs(F.col("__m")) - 10))
    out = kept.groupBy(*by).agg(lufs(F.avg(energy)).alias("loudness"))
    return blocks.select(*by).distinct().join(out, by, "left").withColumn("loudness", F.coalesce("loudness", F.lit(FLOOR_DB)))


def loudness_range(short: DataFrame, momentary: DataFrame, by: list[str], energy: str) -> DataFrame:
    """Distance of the 95th and 10th percentile of short-term loudness over −70 LUFS and 20 under the integrated one."""
    whole = integrated_loudness(momentary, by, energy)
    rows = short.withColumn("__l", lufs(F.col(energy))).join(whole, by).where((F.col("__l") >= -70) & (F.col("__l") >= F.col("loudness") - 20))
    found = rows.groupBy(*by).agg(F.expr("percentile(__l, array(0.1, 0.95))").alias("__p"), F.count(F.lit(1)).alias("__n"))
    value = F.when(F.col("__n") >= 2, F.get("__p", F.lit(1)) - F.get("__p", F.lit(0))).otherwise(0.0)
    return short.select(*by).distinct().join(found.select(*by, value.alias("range")), by, "left").withColumn("range", F.coalesce("range", F.lit(0.0)))


def source_interactions(powers: DataFrame, by: list[str], role: str, power: str) -> DataFrame:
    """Power of dialogue, music and effects in each frame, their shares, and the dialogue's masking risk.

    role holds D, M, E or ME; ME counts half for M and half for E. Frames without any power have shares of 0.
    """
    part = F.when(F.col(role) == "ME", F.array(F.struct(F.lit("M").alias("r"), F.lit(0.5).alias("k")), F.struct(F.lit("E").alias("r"), F.lit(0.5).alias("k")))).otherwise(
        F.array(F.struct(F.col(role).alias("r"), F.lit(1.0).alias("k")))
    )
    rows = powers.where(F.col(role).isin("D", "M", "E", "ME")).select(*by, F.greatest(F.col(power), F.lit(0.0)).alias("__p"), F.inline(part))
    total = lambda r: F.coalesce(F.sum(F.when(F.col("r") == r, F.col("__p") * F.col("k"))), F.lit(0.0))
    out = rows.groupBy(*by).agg(total("D").alias("d"), total("M").alias("m"), total("E").alias("e"))
    whole = F.col("d") + F.col("m") + F.col("e")
    share = lambda c: F.when(whole > 0, F.col(c) / whole).otherwise(0.0)
    return out.withColumns({"d_share": share("d"), "m_share": share("m"), "e_share": share("e"), "masking": masking_risk(F.col("d"), F.col("m") + F.col("e"))})


#: Parts of the range of values in which order statistics are looked for, so that a large group is many tasks' work.
RANGES = 64


def _middle(counted: DataFrame, by: list[str]) -> DataFrame:
    """Of groups of three or more values: by, __xs (the three values from place (size - 2) div 2, from 0, in order), __even.

    counted: by, i, x, n, each value once in a group with its number. Only the ranges that hold the middle are sorted.
    """
    steps = [k / RANGES for k in range(1, RANGES)]
    bounds = counted.groupBy("i").agg(F.percentile_approx("x", steps, 1_000).alias("__b"))
    rows = counted.join(F.broadcast(bounds), "i").withColumn("__r", F.size(F.filter("__b", lambda v: v < F.col("x")))).drop("__b")
    w = Window.partitionBy(*by)
    ranges = rows.groupBy(*by, "__r").agg(F.sum("n").alias("c"))
    ranges = ranges.withColumn("size", F.sum("c").over(w)).withColumn("__from", F.sum("c").over(w.orderBy("__r")) - F.col("c"))
    ranges = ranges.where("size >= 3").withColumn("__lo", F.floor((F.col("size") - 2) / 2))
    ranges = ranges.where("__from <= __lo + 2 AND __from + c > __lo").drop("c")
    near = rows.join(ranges, [*by, "__r"])
    upto = F.col("__from") + F.sum("n").over(Window.partitionBy(*by, "__r").orderBy("x"))
    near = near.withColumn("__to", upto).withColumn("__at", F.col("__to") - F.col("n") - F.col("__lo")).withColumn("__to", F.col("__to") - F.col("__lo"))
    at = lambda q: F.max(F.when((F.col("__at") <= q) & (F.col("__to") > q), F.col("x")))
    return near.groupBy(*by).agg(F.array(at(0), at(1), at(2)).alias("__xs"), (F.max("size") % 2 == 0).alias("__even"))


def _above(x: Column) -> Column:
    """How many of the two values in the middle of the others stand below x; an even group has one such value, counted twice."""
    low, high = F.get("__xs", F.lit(0)), F.when(F.col("__even"), F.get("__xs", F.lit(0))).otherwise(F.get("__xs", F.lit(1)))
    return (x > low).cast("int") + (x > high).cast("int")


def _others_median(above: Column) -> Column:
    """Median of a group without a value that so many of the middle values stand below."""
    a, b, c = (F.get("__xs", F.lit(i)) for i in range(3))
    even = F.when(above == 0, b).otherwise(a)
    return F.when(F.col("__even"), even).otherwise(F.when(above == 0, b + c).when(above == 1, a + c).otherwise(a + b) / 2)


def line_outliers(rows: DataFrame, key: str, speaker: str, values: list[str], least: float = 3.5) -> DataFrame:
    """Rows far from their peers: key, speaker, score.

    Peers are the other rows of the same speaker; of a row without speaker, and where they are fewer than two, all
    others. The score is the root mean square of deviations from the peers' median over 1.4826 times their median
    absolute deviation, in the dimensions where that exceeds 1e-6. A group without one of its rows has one of three
    medians, which follow from three values in its middle; so has each of their deviations.
    """
    sizes = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("__size"))
    named = F.coalesce(F.trim(speaker), F.lit("")) != ""
    rows = rows.join(sizes, speaker, "left").withColumn("__g", F.when(named & (F.col("__size") >= 3), F.concat(F.lit("s:"), F.col(speaker)))).drop("__size")
    # rows that are compared with all others form one more group, of which everybody is a member
    own = rows.where("__g IS NOT NULL").withColumn("__asks", F.lit(True))
    lonely = rows.where("__g IS NULL").select("__g").limit(1).count()
    if lonely:
        own = own.unionByName(rows.withColumn("__asks", F.col("__g").isNull()).withColumn("__g", F.lit("all")))
    long = own.select(key, speaker, "__g", "__asks", F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("i", "x")).where("x IS NOT NULL")
    counted = long.groupBy("__g", "i", "x").agg(F.count(F.lit(1)).alias("n"))

    middle = _middle(counted, ["__g", "i"])
    cases = middle.withColumn("__c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("NOT (__even AND __c = 1)")
    cases = cases.select("__g", "i", "__c", _others_median(F.col("__c")).alias("__m"))
    apart = counted.join(cases, ["__g", "i"]).groupBy("__g", "i", "__c", F.abs(F.col("x") - F.col("__m")).alias("x")).agg(F.sum("n").alias("n"))
    spread = _middle(apart, ["__g", "i", "__c"]).join(cases, ["__g", "i", "__c"])

    asked = long.where("__asks").join(middle, ["__g", "i"]).withColumn("__c", _above(F.col("x"))).drop("__xs", "__even").join(spread, ["__g", "i", "__c"])
    asked = asked.withColumn("__s", 1.4826 * _others_median(_above(F.abs(F.col("x") - F.col("__m")))))
    term = F.when(F.col("__s") > 1e-6, F.pow((F.col("x") - F.col("__m")) / F.col("__s"), 2))
    out = asked.groupBy(key, speaker).agg(F.coalesce(F.sqrt(F.avg(term)), F.lit(0.0)).alias("score"))
    return out.where(F.col("score") >= least).withColumn("score", F.round("score", 6))


def novelty(rows: DataFrame, by: list[str], order: str, vector: str, dim: int, window: int = 4) -> DataFrame:
    """1 − cosine of the mean of the `window` vectors up to each row and of those after it, the last row 0, scaled to 0..1 a group."""
    w = Window.partitionBy(*by).orderBy(order)
    mean = lambda i, a, b: F.avg(F.get(vector, F.lit(i)).cast("double")).over(w.rowsBetween(a, b))
    rows = rows.withColumn("__a", F.array(*[mean(i, -(window - 1), 0) for i in range(dim)])).withColumn("__b", F.array(*[mean(i, 1, window) for i in range(dim)]))
    raw = F.when(F.lead(order).over(w).isNull(), 0.0).otherwise(1 - dot(F.col("__a"), F.col("__b")) / ((norm(F.col("__a")) + 1e-9) * (norm(F.col("__b")) + 1e-9)))
    rows = rows.withColumn("__raw", raw).drop("__a", "__b")
    all_ = Window.partitionBy(*by)
    low, high = F.min("__raw").over(all_), F.max("__raw").over(all_)
    return rows.withColumn("novelty", F.when(high > low, (F.col("__raw") - low) / (high - low)).otherwise(0.0)).drop("__raw")


def fuse(scores: DataFrame, weights: dict[str, float], constant: float) -> Column:
    """Logistic fusion of feature columns."""
    total = F.lit(constant)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return 1 / (1 + F.exp(-total))


def aggregate_rows(rows: DataFrame, by: list[str], index: str, value: str, factor: int) -> DataFrame:
    """Means of so many consecutive rows."""
    return rows.groupBy(*by, F.floor(F.col(index) / factor).alias("block")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def roundtrip(rows: DataFrame, by: list[str], original: str, copy: str) -> DataFrame:
    """Signal-to-noise ratio in dB, greatest error and uncentred correlation of a copy."""
    o, c = F.col(original).cast("double"), F.col(copy).cast("double")
    sums = rows.groupBy(*by).agg(F.sum(o * o).alias("s"), F.sum((o - c) * (o - c)).alias("e"), F.max(F.abs(o - c)).alias("max_error"), F.sum(o * c).alias("x"), F.sum(c * c).alias("t"))
    snr = F.when(F.col("e") > 0, 10 * F.log10(F.col("s") / F.col("e"))).otherwise(float("inf"))
    return sums.select(*by, snr.alias("snr_db"), "max_error", F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("x") / F.sqrt(F.col("s") * F.col("t"))).otherwise(0.0).alias("correlation"))
