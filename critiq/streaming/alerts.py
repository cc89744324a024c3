"""Negative-rate alert windows over a review stream.

The batch alert (``operators.alerts``) looks back 1, 3, 7 and 14 days from
the latest review.  On a stream the same tiers become sliding event-time
windows per shop, with a watermark that bounds state: late rows older than
the watermark are dropped, and each window's state is removed once the
watermark passes its end.

``latest_alerts`` is the batch alert itself on a stream: one stateful query
that keeps, for every shop, its review counts of the last 14 days and emits
the most severe tier that fires whenever the reference time moves on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from critiq.functions.num import to_double
from critiq.operators.alerts import ALERT_ACTIONS, ALERT_LEVELS, MIN_SHOP_REVIEWS, MIN_WINDOW_REVIEWS, tiers
from critiq.operators.common import is_neg
from critiq.operators.sequential import prep_time


def windowed_negative_rates(stream: DataFrame, days: int = 14, slide: str = "1 day",
                            watermark: str = "1 day") -> DataFrame:
    """Per shop and sliding window: reviews, negatives and their rate."""
    if stream.schema["review_time"].dataType.typeName() != "timestamp":
        stream = stream.withColumn("review_time", F.col("review_time").cast("timestamp"))
    return (stream.withWatermark("review_time", watermark)
            .groupBy("shop_id", F.window("review_time", f"{days} days", slide))
            .agg(F.count(F.lit(1)).alias("reviews"), F.sum(is_neg(F.col("sentiment_label"))).alias("negatives"))
            .select("shop_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "reviews", "negatives", (F.col("negatives") / F.col("reviews")).alias("neg_rate")))


def tier_alerts(stream: DataFrame, level: str = "P3", watermark: str = "1 day", slide: str = "1 day") -> DataFrame:
    """Windows of one tier whose negative rate reaches its threshold."""
    lvl = {l: (d, t, name) for l, d, t, name in ALERT_LEVELS}[level]
    days, thr, name = lvl
    w = windowed_negative_rates(stream, days, slide, watermark)
    return (w.where((F.col("reviews") >= MIN_WINDOW_REVIEWS) & (F.col("neg_rate") >= F.lit(thr)))
             .withColumn("level", F.lit(name)))


DAY = 86_400_000_000  # microseconds
STATE = ("times array<long>, counts array<long>, negatives array<long>, total long, score_sum double, scores long, "
         "name string, name_time long, emitted string")


def _merged(times: np.ndarray, *amounts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different times in order, and the amounts added up per time."""
    at, place = np.unique(times, return_inverse=True)
    return at, *[np.bincount(place, x, len(at)).astype(np.int64) for x in amounts]


def latest_alerts(stream: DataFrame, levels=ALERT_LEVELS, actions=ALERT_ACTIONS,
                  delay: timedelta = timedelta(days=1)) -> DataFrame:
    """The columns of ``operators.alerts.alerts`` and ``evaluated_at``, in update
    mode: the newest row of a shop is its alert at that reference time, with a
    null level where no tier fires (any more).

    The reference time is the watermark plus ``delay``: the latest review time
    that the query has seen, in whole milliseconds.  Reviews that come more than
    ``delay`` after later ones are dropped.  State per shop: counts per review
    time of the longest window (older ones go), the totals, and the row emitted
    last, as only changes are emitted.  Shops are looked at again by an
    event-time timeout whenever the reference time moves, until their last
    review has left the windows.  Reviews without a shop move the reference
    time alone; reviews without a time are left out.
    """
    lag = int(delay.total_seconds() * 1000)
    span = max(days for _, days, _, _ in levels)
    d = prep_time(stream).withColumn("review_time", F.col("review_time").cast("timestamp"))
    d = d.withWatermark("review_time", f"{lag} milliseconds").select(
        "shop_id", "shop_name", "review_time", F.unix_micros("review_time").alias("micros"),
        is_neg(F.col("sentiment_label")).cast("long").alias("neg"), to_double("review_score").alias("score"))
    names = [f"_{k}_{lvl}" for lvl, _, _, _ in levels for k in "nx"]
    columns = ["shop_id", "shop_name", "micros", "_n", "_s", "_c", *names]

    def look(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            for _ in batches:
                pass
            return
        if state.exists:
            times, counts, negatives, total, score_sum, scores, name, name_time, emitted = state.get
            times, counts, negatives = (np.array(x, np.int64) for x in (times, counts, negatives))
        else:
            times = counts = negatives = np.empty(0, np.int64)
            total, score_sum, scores, name, name_time, emitted = 0, 0.0, 0, None, 0, ""
        if not state.hasTimedOut:
            for pdf in batches:
                at, n, x = _merged(pdf["micros"].to_numpy(np.int64), np.ones(len(pdf)), pdf["neg"].to_numpy())
                times, counts, negatives = _merged(np.append(times, at), np.append(counts, n), np.append(negatives, x))
                total += len(pdf)
                score_sum += float(pdf["score"].sum())
                scores += int(pdf["score"].notna().sum())
                named = pdf[pdf["shop_name"].notna()]
                if len(named):  # the name of the earliest review, the least of equals
                    first = min(zip(named["micros"], named["shop_name"]))
                    if name is None or first < (name_time, name):
                        name_time, name = int(first[0]), first[1]
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            ref = (now + lag) * 1000
            recent = times >= ref - span * DAY
            times, counts, negatives = times[recent], counts[recent], negatives[recent]
            row = [total, score_sum, scores]
            for _, days, _, _ in levels:
                inside = times >= ref - days * DAY
                row += [int(counts[inside].sum()), int(negatives[inside].sum())]
            if total >= MIN_SHOP_REVIEWS and emitted != (seen := repr((name, row))):
                emitted = seen
                yield pd.DataFrame([[key[0], name, ref, *row]], columns=columns)
        state.update((times.tolist(), counts.tolist(), negatives.tolist(), total, score_sum, scores, name, name_time, emitted))
        if len(times):
            state.setTimeoutTimestamp(max(now, 0) + 1)

    schema = "shop_id string, shop_name string, micros long, _n long, _s double, _c long, " + ", ".join(f"{n} long" for n in names)
    seen = d.groupBy("shop_id").applyInPandasWithState(look, schema, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return tiers(seen.withColumn("evaluated_at", F.timestamp_micros("micros")), levels, actions, keep=("evaluated_at",))


def start(stream: DataFrame, checkpoint: str, query_name: str, level: str = "P3",
          output_mode: str = "append", sink: str = "parquet", path: str | None = None,
          trigger_seconds: int | None = None):
    """Start the tier query.  ``checkpoint`` must be a shared, durable folder, as
    must ``path``, the folder that a file sink writes to."""
    w = tier_alerts(stream, level).writeStream.outputMode(output_mode).format(sink) \
        .option("checkpointLocation", checkpoint).queryName(query_name)
    if path:
        w = w.option("path", path)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
