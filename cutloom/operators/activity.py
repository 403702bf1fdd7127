"""Words and lines against frame series: dominant sources, nearest sources, means, boundary scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the boundary features and the constant, by the features at hand.
BOUNDARY_WEIGHTS = {
    "full": ({"clip_dp": 3.8306, "clip_nov": -0.1764, "dino_nov": 4.4968, "audio_nov": 2.6071, "dlg_span": -0.177}, -3.9381),
    "no_audio": ({"clip_dp": 3.6853, "clip_nov": -0.4299, "dino_nov": 4.1534, "dlg_span": -0.288}, -3.0746),
    "no_dialogue": ({"clip_dp": 3.8298, "clip_nov": -0.1709, "dino_nov": 4.4887, "audio_nov": 2.6242}, -3.962),
    "visual_only": ({"clip_dp": 3.6778, "clip_nov": -0.425, "dino_nov": 4.1488}, -3.1971),
}
#: Fixed value: score from which a shot ends a scene.
BOUNDARY_THRESHOLD = 0.6


def boundary_scores(features: DataFrame) -> DataFrame:
    """Logistic fusion of clip_dp, clip_nov, dino_nov and, where the frame has them, audio_nov and dlg_span; adds score and variant."""
    audio, spans = "audio_nov" in features.columns, "dlg_span" in features.columns
    variant = {(True, True): "full", (False, True): "no_audio", (True, False): "no_dialogue", (False, False): "visual_only"}[audio, spans]
    weights, constant = BOUNDARY_WEIGHTS[variant]
    total: Column = F.lit(constant)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return features.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("variant", F.lit(variant))


def frames_of(rows: DataFrame, frames: DataFrame, on: list[str], hop: float, start: str = "start", end: str = "end", index: str = "i") -> DataFrame:
    """Rows joined with the frames they touch, from floor(start / hop) up to ceil(end / hop), at least one."""
    first = F.greatest(F.lit(0), F.floor(F.col(start) / hop)).cast("bigint")
    last = F.greatest(first, F.ceil(F.col(end) / hop).cast("bigint") - 1)
    spread = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(index, F.explode(F.sequence(first, last)))
    return spread.join(frames, [*on, index])


def dominant_source(words: DataFrame, levels: DataFrame, on: list[str], key: str, hop: float, least: float = -50.0, margin: float = 1.0) -> DataFrame:
    """The source whose 90th percentile level over a word is loud enough and leads by the margin: key, source, level; null source else.

    levels: on, source, i, level. Levels of minus infinity don't count; a word without any level has no source.
    """
    hit = frames_of(words.select(*on, key, "start", "end"), levels.where(F.col("level") > float("-inf")), on, hop)
    score = hit.groupBy(*on, key, "source").agg(F.expr("percentile(level, 0.9)").alias("level"))
    w = Window.partitionBy(*on, key).orderBy(F.desc("level"), "source")
    ranked = score.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("level").over(w)).where("n = 1")
    clear = (F.col("level") >= least) & (F.col("next").isNull() | (F.col("level") - F.col("next") >= margin))
    best = ranked.select(*on, key, F.when(clear, F.col("source")).alias("source"), F.when(clear, F.round("level", 3)).alias("level"))
    return words.select(*on, key).join(best, [*on, key], "left")


def nearest_source(words: DataFrame, sources: DataFrame, on: list[str], key: str, most: int = 750, ambiguous: int = 50, bucket: int = 1_000) -> DataFrame:
    """The source nearest in time to each word, within `most`; none where the next one is hardly farther: key, source, ambiguous.

    Candidates are found by an overlap join of the words, widened by what could matter, with the sources' intervals.
    """
    from cutloom.operators.overlap import overlap_join

    reach = most + ambiguous + 1
    wide = words.select(*on, key, "start", "end", (F.col("start") - reach).alias("__a"), (F.col("end") + reach).alias("__b"))
    own = sources.where("source IS NOT NULL AND source != ''").select(*on, "source", F.col("start").alias("__s"), F.greatest(F.col("end"), F.col("start") + 1).alias("__t"), F.col("end").alias("__e"))
    pairs = overlap_join(wide, own, on, ("__a", "__b"), ("__s", "__t"), bucket)
    apart = F.greatest(F.col("__s") - F.col("end"), F.col("start") - F.col("__e"), F.lit(0))
    near = pairs.groupBy(*on, key, "source").agg(F.min(apart).alias("d"))
    w = Window.partitionBy(*on, key).orderBy("d", "source")
    best = near.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("d").over(w)).where("n = 1")
    clear = (F.col("d") <= most) & (F.col("next").isNull() | (F.col("next") - F.col("d") > ambiguous))
    best = best.select(*on, key, F.when(clear, F.col("source")).alias("source"))
    return words.select(*on, key).join(best, [*on, key], "left").withColumn("ambiguous", F.col("source").isNull())


def means_over_frames(rows: DataFrame, frames: DataFrame, on: list[str], key: str, values: list[str], hop: float) -> DataFrame:
    """Means of frame values over each row's time."""
    return frames_of(rows.select(*on, key, "start", "end"), frames, on, hop).groupBy(*on, key).agg(*[F.avg(v).alias(v) for v in values])


#: Frames next to a cut that are kept off; rounds of windows that are offered.
EDGE_FRAMES, ROUNDS = 2, 4


def keyframes(start: Column, end: Column, count: int = 3) -> Column:
    """Evenly spaced frames of [start, end), both ends included; frames next to the cuts are left out where the shot is long enough."""
    long = end - 1 - start >= 2 * EDGE_FRAMES + count
    low, high = F.when(long, start + EDGE_FRAMES).otherwise(start), F.when(long, end - 1 - EDGE_FRAMES).otherwise(end - 1)
    middle = F.array(F.floor((low + high) / 2))
    if count == 1:
        return middle
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (low + F.rint(i * (high - low) / (count - 1))).cast("bigint"))
    return F.when(high <= low, middle).otherwise(F.array_sort(F.array_distinct(spread)))


def probe_starts(duration: Column, window: float, count: int, rounds: int = ROUNDS) -> Column:
    """Starts of windows in the order in which they are tried: each round spans the programme, the next ones shift it."""
    span = duration - window
    tries = F.sequence(F.lit(0), F.lit(count * rounds - 1))
    starts = F.transform(tries, lambda n: span * (n % count + (F.floor(n / count) + 0.5) / rounds) / count)
    return F.when(span <= 0, F.array(F.lit(0.0))).otherwise(F.array_distinct(starts))


def accepted_gaps(gaps: DataFrame, silent_db: float = -80.0, crest: float = 6.0) -> DataFrame:
    """Gaps with the reason they can't serve as room tone: digital_silence, transient; null where they can. Needs rms_db, peak (linear) and rms."""
    reason = F.when(F.col("rms_db") <= silent_db, "digital_silence").when(F.col("peak") / F.greatest(F.col("rms"), F.lit(1e-12)) > crest, "transient")
    return gaps.withColumn("reason", reason)


def tone_spans(groups: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Spans between the midpoints of neighbouring gaps, of one group joined: by, group, start, end. groups: by, group, start, end; totals: by, total."""
    w = Window.partitionBy(*by).orderBy("centre", "group")
    rows = groups.withColumn("centre", (F.col("start") + F.col("end")) / 2)
    rows = rows.withColumn("__from", F.coalesce((F.lag("centre").over(w) + F.col("centre")) / 2, F.lit(0.0))).withColumn("__new", (~F.lag("group").over(w).eqNullSafe(F.col("group"))).cast("int"))
    rows = rows.withColumn("__n", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(*by, "__n", "group").agg(F.min("__from").alias("start"))
    following = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    return spans.join(totals, by).select(*by, "group", "start", F.coalesce(following, F.col("total")).alias("end"))
