"""Per-key gates: events that pass depend on which earlier event passed last.

Such a rule is a chain of jumps "from this event to the next one allowed". Instead
of folding a whole key in one task, the jump of every event is computed up front and
the visited events are found by doubling the jumps, in a logarithmic number of
equi joins on unique ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.session import durable

MICRO = 1_000_000


def _micros(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _hour(c: str) -> Column:
    return F.floor(F.col(c) / (3600 * MICRO))


def _place(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Add ``_t`` (microseconds) and the position ``_n`` of each event in its key."""
    timed = events.withColumn("_t", _micros(at))
    return skew.position(timed, [key], _hour("_t"), [F.col("_t"), *[F.col(o) for o in order]], "_n")


def _first_from(placed: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """For each probe ``(key, _id, _from)`` the position of the first event at or after
    the instant ``_from``, NULL when there is none. No key is held by one task."""
    marks = placed.select(key, F.col("_t"), F.lit(1).alias("_event"), F.lit(None).cast("long").alias("_id"))
    marks = marks.unionByName(probes.select(key, F.col("_from").alias("_t"), F.lit(0).alias("_event"), "_id"))
    counted = skew.running_sum(
        marks, [key], _hour("_t"), [F.col("_t"), F.col("_event"), F.col("_id")], F.col("_event").cast("long"), "_seen"
    )
    sizes = placed.groupBy(key).agg(F.max("_n").alias("_last"))
    found = counted.filter(F.col("_event") == 0).join(sizes, key)
    return found.select(key, "_id", F.when(F.col("_seen") < F.col("_last"), F.col("_seen") + 1).alias("_next"))


def orbit(jumps: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Nodes reached from ``starts(key, _node)`` along ``jumps(key, _node, _next)``."""
    reached = durable(starts.select(key, "_node").distinct())
    hops = durable(jumps.filter(F.col("_next").isNotNull()).select(key, "_node", "_next"))
    while True:
        step = reached.join(hops, [key, "_node"]).select(key, F.col("_next").alias("_node"))
        grown = durable(reached.unionByName(step).distinct())
        then = hops.select(F.col(key), F.col("_node").alias("_next"), F.col("_next").alias("_far"))
        hops = durable(hops.join(then, [key, "_next"]).select(key, "_node", F.col("_far").alias("_next")))
        reached = grown
        if hops.isEmpty():
            return reached


def cooldown_gate(turns: DataFrame, seconds: float, key: str = "session_id", at: str = "created_at", order: tuple[str, ...] = ("turn_id",)) -> DataFrame:
    """Turns that pass when at least ``seconds`` lie since the last turn that passed.

    An event that follows a gap of ``seconds`` passes in any case, so only the chains
    inside busy stretches need jumps; the number of rounds is logarithmic in the
    longest chain.
    """
    placed = _place(turns, key, at, list(order))
    if seconds <= 0:
        return placed.drop("_t", "_n")
    wait = int(seconds * MICRO)
    placed = durable(placed)
    before = skew.neighbour(placed, [key], _hour("_t"), [F.col("_n")], F.struct(F.col("_t").alias("t")), "_before", ahead=False)
    free = before.filter(F.col("_before").isNull() | (F.col("_t") - F.col("_before.t") >= wait))
    probes = placed.select(key, F.col("_n").alias("_id"), (F.col("_t") + wait).alias("_from"))
    jumps = _first_from(placed, probes, key).select(key, F.col("_id").alias("_node"), "_next")
    # A jump onto a free event adds nothing: that event is a start of its own.
    onto = free.select(key, F.col("_n").alias("_next"))
    jumps = jumps.join(onto, [key, "_next"], "left_anti")
    passed = orbit(jumps, free.select(key, F.col("_n").alias("_node")), key)
    return placed.join(passed.withColumnRenamed("_node", "_n"), [key, "_n"], "left_semi").drop("_t", "_n")


def apply_access(facts: DataFrame, reads: DataFrame, seconds: int = 60, every: int = 5, key: str = "fact_key", at: str = "read_at", order: tuple[str, ...] = ("read_id",), reconsolidation: bool = False) -> DataFrame:
    """Access count and last access of each fact after a batch of reads. With
    ``reconsolidation`` a counted read is stamped as ``last_recalled_at`` too.

    A read counts when ``seconds`` have passed since the last counted one, or when the
    new count is a multiple of ``every``. The state of the chain is (read, count modulo
    ``every``), so each read has one jump per remainder.
    """
    wait = seconds * MICRO
    base = facts.withColumn("access_count", F.coalesce("access_count", F.lit(0)))
    known = reads.join(base.select(key), key, "left_semi")
    placed = durable(_place(known.select(key, at, *order), key, at, list(order)))
    remainder = F.explode(F.sequence(F.lit(0), F.lit(every - 1)))
    probes = placed.select(key, F.col("_n").alias("_id"), (F.col("_t") + wait).alias("_from"))
    later = _first_from(placed, probes, key).select(key, F.col("_id").alias("_n"), "_next")
    sizes = placed.groupBy(key).agg(F.max("_n").alias("_last"))

    def node(n: Column, r: Column) -> Column:
        return n * every + r

    after = F.pmod(F.col("_r") + 1, F.lit(every))
    jumps = (
        placed.select(key, "_n")
        .join(later, [key, "_n"])
        .join(sizes, key)
        .withColumn("_r", remainder)
        .withColumn(
            "_to",
            F.when(F.col("_r") + 1 == every, F.when(F.col("_n") < F.col("_last"), F.col("_n") + 1)).otherwise(F.col("_next")),
        )
        .select(key, node(F.col("_n"), F.col("_r")).alias("_node"), node(F.col("_to"), after).alias("_next"))
    )
    # ``_r`` of a node is the count modulo ``every`` after its read was counted.
    begin = base.select(key, "access_count", _micros("last_accessed_at").alias("_last_t"))
    first = _first_from(
        placed, begin.select(key, F.lit(0).cast("long").alias("_id"), F.coalesce(F.col("_last_t") + wait, F.lit(0)).alias("_from")), key
    ).select(key, F.col("_next").alias("_entry"))
    starts = (
        begin.join(first, key)
        .withColumn("_entry", F.when((F.col("access_count") + 1) % every == 0, F.lit(1)).otherwise(F.col("_entry")))
        .filter(F.col("_entry").isNotNull())
        .select(key, node(F.col("_entry"), (F.col("access_count") + 1) % every).cast("long").alias("_node"))
    )
    counted = (
        orbit(jumps.select(key, F.col("_node").cast("long").alias("_node"), F.col("_next").cast("long").alias("_next")), starts, key)
        .select(key, F.floor(F.col("_node") / every).alias("_n"))
        .join(placed, [key, "_n"])
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_more"), F.max(at).alias("_latest"))
    )
    if reconsolidation:
        recalled = F.col("last_recalled_at") if "last_recalled_at" in base.columns else F.lit(None).cast("timestamp_ntz")
        base = base.withColumn("last_recalled_at", recalled)
    return (
        base.join(counted, key, "left")
        .withColumns({"last_recalled_at": F.coalesce("_latest", "last_recalled_at")} if reconsolidation else {})
        .withColumn("access_count", (F.col("access_count") + F.coalesce("_more", F.lit(0))).cast("int"))
        .withColumn("last_accessed_at", F.coalesce("_latest", "last_accessed_at"))
        .drop("_more", "_latest")
    )
