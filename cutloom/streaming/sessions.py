"""Sessions of words over a stream: gaps by session windows, gaps and speakers by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source string, speaker string, start timestamp, end timestamp, n_words bigint, text string"
STATE = "speaker string, start double, end double, n bigint, text string"


def gap_sessions(words: DataFrame, gap: str, late: str, by: list[str], time: str = "ts") -> DataFrame:
    """Counts of sessions that end after a gap, late rows up to the watermark included: by, start, end, n."""
    window = F.session_window(time, gap)
    return words.withWatermark(time, late).groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hop_levels(events: DataFrame, width: str, late: str, by: list[str], value: str, time: str = "ts", slide: str | None = None) -> DataFrame:
    """Means over tumbling or sliding windows: by, start, mean, n."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*by, window.alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), "mean", "n")


def distinct_rows(rows: DataFrame, key: list[str], late: str, time: str = "ts") -> DataFrame:
    """The first row of each key inside the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def word_groups(words: DataFrame, max_gap: float, late: str) -> DataFrame:
    """Groups of words of a source, ended by a gap over max_gap seconds or another speaker; emitted once the watermark is past them.

    words: source, speaker (blank takes on the group's), ts (start), seconds (length), text. The state of a source is its
    open group; blank speakers never break it.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        open_ = list(state.get) if state.exists else None
        if state.hasTimedOut:
            done.append(tuple(open_))
            open_ = None
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for r in rows.itertuples():
                at = r.ts.timestamp()
                who, end = (r.speaker or "").strip(), at + float(r.seconds or 0)
                if open_ and (at - open_[2] > max_gap or (who and open_[0] and who != open_[0])):
                    done.append(tuple(open_))
                    open_ = None
                if open_ is None:
                    open_ = [who, at, end, 1, r.text or ""]
                else:
                    open_ = [open_[0] or who, open_[1], end, open_[3] + 1, f"{open_[4]} {r.text or ''}".strip()]
            state.update(tuple(open_))
            state.setTimeoutTimestamp(max(int((open_[2] + max_gap) * 1000), state.getCurrentWatermarkMs() + 1))
        if done:
            stamp = lambda t: pd.Timestamp(round(t * 1_000_000), unit="us")
            yield pd.DataFrame([(key[0], w, stamp(a), stamp(b), n, t) for w, a, b, n, t in done], columns=["source", "speaker", "start", "end", "n_words", "text"])

    return words.withWatermark("ts", late).groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
