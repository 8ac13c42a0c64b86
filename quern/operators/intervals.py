"""Operators over half-open intervals: presence sweeps, clamping and at-most-once conflict resolution."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a time bucket that instants are swept in.
BUCKET = 3600
#: Lengths of a window in a bucket of time that windows and their samples meet in.
SPANS = 16


def encounters(rows: DataFrame, least: float = 0) -> DataFrame:
    """place, start, stop, n_agents: maximal runs of at least `least` seconds in which two or more agents are at a place, and
    how many agents took part. rows: place, agent, start, stop.

    A sweep over the instants at which agents come and go: how many are there is a running sum, a run goes from where it
    reaches two to where it falls below. Those who come within a run take part, and so does the one agent who was there before: of all
    intervals that began earlier, the one that ends last. Running values are worked out in buckets of time, and what they
    start from over the buckets, so a busy place is spread over its buckets and no two intervals ever meet.
    """
    bucket = F.floor(F.col("t") / BUCKET).alias("bucket")
    rows = rows.where("stop > start AND place IS NOT NULL AND agent IS NOT NULL")
    steps = rows.select("place", "agent", F.inline(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d")))))
    steps = steps.groupBy("place", "agent", "t").agg(F.sum("d").alias("d"))
    own = F.sum("d").over(Window.partitionBy("place", "agent").orderBy("t"))
    steps = steps.withColumn("own", own).groupBy("place", "t").agg(F.sum((F.col("own") > 0).cast("int") - (F.col("own") > F.col("d")).cast("int")).alias("d"))
    longest = rows.groupBy("place", F.col("start").alias("t")).agg(F.max(F.struct("stop", "agent")).alias("longest"))
    points = steps.join(longest, ["place", "t"], "left").select("place", bucket, "t", "d", "longest")

    within, by_bucket = Window.partitionBy("place", "bucket").orderBy("t"), Window.partitionBy("place").orderBy("bucket")
    earlier, ahead = by_bucket.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("place").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy("place", "bucket").agg(F.sum("d").alias("d"), F.max("longest").alias("longest"))
    totals = totals.select("place", "bucket", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("n_before"), F.max("longest").over(earlier).alias("longest_before"))
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    points = points.join(totals, ["place", "bucket"])
    points = points.select("place", "bucket", "t", "d", (F.col("n_before") + F.sum("d").over(within)).alias("n"), F.greatest("longest_before", F.max("longest").over(before)).alias("longest"))
    points = points.withColumns({"starts": F.when((F.col("n") > 1) & (F.col("n") - F.col("d") < 2), F.col("t")), "stops": F.when((F.col("n") < 2) & (F.col("n") - F.col("d") > 1), F.col("t"))})

    edges = points.groupBy("place", "bucket").agg(F.max("starts").alias("last"), F.min("stops").alias("first"))
    edges = edges.select("place", "bucket", F.max("last").over(earlier).alias("last_before"), F.min("first").over(ahead).alias("first_after"))
    following = F.min("stops").over(Window.partitionBy("place", "bucket").orderBy(F.desc("t")))
    points = points.join(edges, ["place", "bucket"]).select("place", "t", "n", "starts", "longest", F.coalesce(F.max("starts").over(within), "last_before").alias("run"), F.coalesce(following, "first_after").alias("until"))

    runs = points.where("n > 1").select("place", "t", "run", "starts", "until", F.when(F.col("starts").isNotNull() & (F.col("longest.stop") > F.col("t")), F.col("longest.agent")).alias("there"))
    came = rows.select("place", F.col("start").alias("t"), "agent").join(runs.select("place", "t", "run"), ["place", "t"]).select("place", "run", "agent")
    there = runs.where("there IS NOT NULL").select("place", "run", F.col("there").alias("agent"))
    n = came.unionByName(there).distinct().groupBy("place", F.col("run").alias("start")).agg(F.count("*").alias("n_agents"))
    found = runs.where("starts IS NOT NULL").select("place", F.col("starts").alias("start"), F.col("until").alias("stop")).where(F.col("stop") - F.col("start") >= least)
    return found.join(n, ["place", "start"]).select("place", "start", "stop", "n_agents")


def clamped(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Intervals in order, each starting no earlier than the ones before it end; adds new_start, new_stop."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.greatest("start", "stop")).over(w)
    start = F.greatest(F.col("start"), F.coalesce(before, F.col("start")))
    return rows.withColumn("new_start", start).withColumn("new_stop", F.greatest(F.col("new_start"), F.col("stop")))


def resolved(rows: DataFrame) -> DataFrame:
    """agent, event_id, keeps: meetings (agent, event_id, start, stop, priority) of one agent that overlap, decided in order
    of start: the one of lower priority number stays, the earlier on a tie; each is decided once. Sequential per agent."""

    def decide(meetings: pd.DataFrame) -> pd.DataFrame:
        m = meetings.sort_values(["start", "event_id"])
        keeps = np.ones(len(m), bool)
        last = stop = priority = None
        for i, (start, end, p) in enumerate(zip(m["start"].to_numpy(), m["stop"].to_numpy(), m["priority"].to_numpy(), strict=True)):
            if last is not None and start < stop and priority <= p:
                keeps[i] = False
                continue
            if last is not None and start < stop:
                keeps[last] = False
            last, stop, priority = i, end, p
        return pd.DataFrame({"agent": m["agent"], "event_id": m["event_id"], "keeps": keeps})

    return rows.groupBy("agent").applyInPandas(decide, "agent long, event_id long, keeps boolean")


def without_cuts(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """entries (agent, event_id, start, stop) less the parts that cuts (agent, start, stop) of the same agent cover: one row
    (agent, event_id, start, stop) per piece that is left, in as many pieces as the cuts make. Entries that no cut touches
    stay whole; those covered through and through are gone."""
    c = cuts.select("agent", F.col("start").alias("from"), F.col("stop").alias("to"))
    met = entries.join(c, (entries["agent"] == c["agent"]) & (F.col("from") < entries["stop"]) & (F.col("to") > entries["start"]), "left").select(entries["*"], "from", "to")
    all_cuts = F.sort_array(F.collect_list(F.when(F.col("from").isNotNull(), F.struct("from", "to"))))
    rows = met.groupBy("agent", "event_id", "start", "stop").agg(all_cuts.alias("cuts"))
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

    def cut(a, x):
        piece = F.struct(a["at"].cast("long").alias("start"), x["from"].cast("long").alias("stop"))
        return F.struct(F.greatest(a["at"], x["to"]).alias("at"), F.when(x["from"] > a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    end = F.aggregate("cuts", first, cut)
    last = F.when(end["at"] < F.col("stop"), F.array(F.struct(end["at"].cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return rows.select("agent", "event_id", F.explode(F.concat(end["out"], last)).alias("p")).select("agent", "event_id", "p.start", "p.stop")


def length_matched(targets: DataFrame, donors: DataFrame, caliper: float = 0.2) -> DataFrame:
    """item, target, donor, fits: each target of an item gets the unused donor of the item nearest in length, the longest
    targets first, the shorter donor on ties; fits: within the caliper. Sequential per item. Inputs: item, name, length."""

    def match(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        wanted = pool[pool["side"] == 0].sort_values(["length", "name"], ascending=[False, True])
        free = pool[pool["side"] == 1].sort_values(["length", "name"])
        lengths, names, rows = free["length"].tolist(), free["name"].tolist(), []
        for name, length in zip(wanted["name"], wanted["length"], strict=True):
            if not lengths:
                break
            i = bisect_left(lengths, length)
            if i == len(lengths) or (i and length - lengths[i - 1] <= lengths[i] - length):
                i = bisect_left(lengths, lengths[i - 1])  # the first name of that length
            rows.append((key[0], name, names[i], bool(abs(lengths[i] - length) <= caliper * length)))
            del lengths[i], names[i]
        return pd.DataFrame(rows, columns=["item", "target", "donor", "fits"])

    pool = targets.select("item", "name", "length", F.lit(0).alias("side")).unionByName(donors.select("item", "name", "length", F.lit(1).alias("side")))
    return pool.groupBy("item").applyInPandas(match, "item long, target string, donor string, fits boolean")


def sampled_windows(samples: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """event_id, n, total, n_values, peak of the samples (event_id, at, value) inside the windows (event_id, at) of an id, each
    `span` long; ids without samples are left out. Values are added one after the other from the latest down (of one time, from the
    greatest id), so that sums do not hang on how rows were dealt out (of sums that lie half way, the order decides the rounding).
    Null values do not count, NaN is a value. A bucket of SPANS windows' length holds the windows that open in it and all samples
    that these may hold; windows that open at once are one sum."""

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        opens, times, ids = part["opens"].to_numpy(bool), part["at"].to_numpy(), part["event_id"].to_numpy()
        order = np.lexsort((ids, times))
        order = order[~opens[order]]
        at, values, known = times[order], part["value"].to_numpy(float)[order], part["known"].to_numpy(bool)[order]
        starts, which = np.unique(times[opens], return_inverse=True)
        ends = zip(np.searchsorted(at, starts), np.searchsorted(at, starts + span), strict=True)
        sums = np.zeros((len(starts), 4))
        for k, (i, j) in enumerate(ends):
            v = values[i:j][known[i:j]][::-1]
            sums[k] = j - i, np.cumsum(v)[-1] if len(v) else 0, len(v), v.max() if len(v) else 0
        found = pd.DataFrame(sums[which], columns=["n", "total", "n_values", "peak"])
        found.insert(0, "event_id", ids[opens])
        return found[found["n"] > 0]

    first, last = (F.floor((F.col("at") - before) / (span * SPANS)) for before in (span, 0))
    w = windows.select("event_id", "at", F.lit(None).cast("double").alias("value"), F.lit(False).alias("known"), F.lit(True).alias("opens"), last.alias("bucket"))
    s = samples.select("event_id", "at", F.col("value").cast("double").alias("value"), F.col("value").isNotNull().alias("known"), F.lit(False).alias("opens"), F.explode(F.array_distinct(F.array(first, last))).alias("bucket"))
    found = w.unionByName(s).where("at IS NOT NULL").groupBy("bucket").applyInPandas(inside, "event_id long, n long, total double, n_values long, peak double")
    valued = lambda name: F.when(F.col("n_values") > 0, F.coalesce(name, F.lit(float("nan"))))  # noqa: E731  (pandas takes NaN for null)
    return found.groupBy("event_id").agg(F.sum("n").alias("n"), F.sum(valued("total")).alias("total"), F.sum("n_values").alias("n_values"), F.max(valued("peak")).alias("peak"))
