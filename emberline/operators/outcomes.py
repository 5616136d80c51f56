"""What became of a signal: which of its stop and take a later bar touched first.

A signal is not joined with the bars after it. Bars lie in buckets of time, buckets in wider ones, and a bucket's lowest low and highest high tell
whether any bar in it touches a price. A signal looks among the later bars of its own bucket, then among the later buckets of the wider one, and so
on up; where it finds a bucket, it looks among what lies in that one, and so on down. A search is a group of one bucket's children and the signals that look
there, at most SIGNALS of them, so bars and bucket rows stay as many as they are and a crash that ends many signals at once is
dealt to many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .candles import DURATIONS, KEY

#: Bars to a bucket, buckets to one of the wider ones, about; signals of one search.
WIDTH, SIGNALS = 4096, 4096
_BEFORE_ALL = -(2**63)


def bucket_micros(interval: str = "interval") -> Column:
    """Microseconds of WIDTH bars of the interval; those of unknown intervals count as a minute each."""
    length = F.lit(60)
    for name, duration in DURATIONS.items():
        amount, unit = duration.split()
        length = F.when(F.col(interval) == name, int(amount) * {"minute": 60, "hour": 3600}[unit.rstrip("s")]).otherwise(length)
    return length.cast("long") * F.lit(1_000_000 * WIDTH)


def _look(signals: pa.Table, nodes: pa.Table) -> pa.Table:
    """The signals of a search with `found`, the first node after theirs that touches one of their prices, and what it touches."""
    nodes = nodes.sort_by([("node", "ascending")])
    at, lowest, highest = (nodes[c].to_numpy() for c in ("node", "lowest", "highest"))
    after, fall, rise = (signals[c].to_numpy() for c in ("after", "fall", "rise"))
    found, fell, rose = np.zeros(len(after), np.int64), np.zeros(len(after), bool), np.zeros(len(after), bool)
    none = np.ones(len(after), bool)
    for i, begin in enumerate(np.searchsorted(at, after, "right").tolist()):
        touched = (lowest[begin:] <= fall[i]) | (highest[begin:] >= rise[i])
        k = begin + int(np.argmax(touched)) if len(touched) else begin
        if k < len(at) and touched[k - begin]:
            first = at[k]
            same = slice(k, int(np.searchsorted(at, first, "right")))  # bars of equal times touch at once
            none[i], found[i], fell[i], rose[i] = False, first, (lowest[same] <= fall[i]).any(), (highest[same] >= rise[i]).any()
    kept = signals.drop_columns([c for c in ("found", "fell", "rose") if c in signals.column_names])
    for name, values in (("found", found), ("fell", fell), ("rose", rose)):
        kept = kept.append_column(name, pa.array(values, mask=none))
    return kept


def _search(pending: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The signals, which have `parent` and `after`, with what they find among the nodes (node, parent, lowest, highest) of their parent."""
    at = [*KEY, "parent"]
    counts = pending.groupBy(*at).agg(F.ceil(F.count("*") / SIGNALS).alias("searches"))
    own = [F.col(f"{c}_") for c in at]
    met = lambda df: df.join(counts.toDF(*(f"{c}_" for c in at), "searches"), [F.col(c).eqNullSafe(f) for c, f in zip(at, own)])
    dealt = met(pending).withColumn("search", F.pmod(F.xxhash64("time", "fall", "rise"), F.col("searches"))).drop("searches", *(f"{c}_" for c in at))
    copied = met(nodes).select(*at, "node", "lowest", "highest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("searches") - 1)).alias("search"))
    fields = [f for f in dealt.schema if f.name not in ("found", "fell", "rose")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "found long, fell boolean, rose boolean"])
    return staged(dealt.groupBy(*at, "search").cogroup(copied.groupBy(*at, "search")).applyInArrow(_look, schema).drop("search"), name)


def first_touches(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Per signal that is a buy or a sell: its columns, exit (stop, take or open), exit_time, exit_price and gain.

    The first later bar of the series whose low and high take in the stop or the take ends it; a bar that takes in both counts as the stop. Prices that are null or NaN
    touch nothing, a stop or take of that kind is never touched, a signal without a time is open. An open signal has no exit time, price or gain. Repeated signals
    are judged each. Columns of these names are replaced.
    """
    made = ["exit", "exit_time", "exit_price", "gain"]
    kept = [c for c in signals.columns if c.lower() not in made]
    buy, sell = F.col("direction") == "BUY", F.col("direction") == "SELL"
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    price = lambda a, b, none: F.coalesce(F.nanvl(F.when(buy, F.col(a)).otherwise(F.col(b)).cast("double"), none), none)
    micros = lambda: F.unix_micros(F.col("time").cast("timestamp"))
    fired = signals.where(buy | sell).select(
        *KEY, "time", F.struct(*kept).alias("signal"), price("stop", "take", least).alias("fall"), price("take", "stop", most).alias("rise"), micros().alias("at"),
    )
    fired = staged(fired.withColumn("wide", bucket_micros()).withColumns({"near": F.floor(F.col("at") / F.col("wide")), "far": F.floor(F.col("at") / F.col("wide") / WIDTH)}).drop("wide"), "fired-signals")

    numbers = lambda c, none: F.coalesce(F.nanvl(F.col(c).cast("double"), none), none)
    leaf = bars.where("time IS NOT NULL").select(*KEY, micros().alias("node"), F.floor(micros() / bucket_micros()).alias("parent"), numbers("low", most).alias("lowest"), numbers("high", least).alias("highest"))
    leaf = staged(leaf, "bars-by-bucket")
    wider = lambda nodes, parent: nodes.groupBy(*KEY, F.col("parent").alias("node")).agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest")).withColumn("parent", parent)
    near = staged(wider(leaf, F.floor(F.col("node") / WIDTH)), "buckets")
    far = staged(wider(near, F.lit(0).cast("long")), "wide-buckets")

    timed = fired.where("at IS NOT NULL")
    first = _search(timed.withColumns({"parent": F.col("near"), "after": F.col("at")}), leaf, "in-own-bucket")
    second = _search(first.where("found IS NULL").withColumns({"parent": F.col("far"), "after": F.col("near")}), near, "in-own-wide-bucket")
    third = _search(second.where("found IS NULL").withColumns({"parent": F.lit(0).cast("long"), "after": F.col("far")}), far, "in-all-buckets")
    down = lambda found: found.where("found IS NOT NULL").withColumns({"parent": F.col("found"), "after": F.lit(_BEFORE_ALL)})
    bucket = _search(down(third), near, "down-to-buckets")
    last = _search(down(second.unionByName(bucket)), leaf, "down-to-bars")

    names = ["signal", "found", "fell", "rose"]
    open_ = third.where("found IS NULL").select(*names).unionByName(fired.where("at IS NULL").select("signal", F.lit(None).cast("long").alias("found"), F.lit(False).alias("fell"), F.lit(False).alias("rose")))
    ended = first.where("found IS NOT NULL").select(*names).unionByName(last.select(*names)).unionByName(open_)
    bought = F.col("signal.direction") == "BUY"
    stopped = F.when(bought, F.col("fell")).otherwise(F.col("rose"))
    ended = ended.withColumn("exit", F.when(F.col("found").isNull(), "open").when(stopped, "stop").otherwise("take"))
    ended = ended.withColumn("exit_price", F.when(F.col("exit") == "stop", F.col("signal.stop")).when(F.col("exit") == "take", F.col("signal.take")))
    gain = F.when(bought, F.col("exit_price") - F.col("signal.entry")).otherwise(F.col("signal.entry") - F.col("exit_price"))
    return ended.select("signal.*", "exit", F.timestamp_micros("found").cast("timestamp_ntz").alias("exit_time"), "exit_price", gain.alias("gain"))
