"""Turns and sessions: recent turns, context windows, replay, summaries, gists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock, text
from loreweave.functions import facts as ff
from loreweave.operators import vector

BLOCK = 1024

# Topic words of a session summary, and phrases that mark a decision.
TOPIC_WORDS = ["decision", "conclusion", "config", "prefer", "plan", "bug", "feature", "design"]
DECISION_PHRASES = ["decision", "concluded", "we will use", "the approach is", "chose", "agreed"]


def placed(turns: DataFrame) -> DataFrame:
    """Turns with their 1-based position ``pos`` in the session."""
    return skew.position(turns, ["session_id"], F.floor(F.col("turn_id") / BLOCK), [F.col("turn_id")])


def last_n_turns(turns: DataFrame, n: int) -> DataFrame:
    return skew.top_per_group(turns, ["session_id"], [F.desc("turn_id")], n, "_back").drop("_back")


def known_turns(turns: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of existing sessions, and the rejected rest."""
    ids = sessions.select("session_id").distinct()
    return turns.join(ids, "session_id", "left_semi"), turns.join(ids, "session_id", "left_anti")


def context_windows(turns: DataFrame, n: int = 10, min_assistant: int = 50) -> DataFrame:
    """Each turn with the text of the ``n`` turns before it; system turns and short
    assistant turns are left out of that text."""
    body = text.squeeze(F.col("content"))
    label = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    kept = (F.col("role") != "system") & ~((F.col("role") == "assistant") & (F.octet_length(body) < min_assistant))
    lined = placed(turns).withColumn("_line", F.when(kept, F.concat(label, F.lit(": "), body, F.lit("\n"))))
    w = Window.partitionBy("session_id", "_block").orderBy("pos").rowsBetween(-n, -1)
    return (
        skew.with_halo(lined, "pos", BLOCK, before=n)
        .withColumn("context", F.concat(F.array_join(F.collect_list("_line").over(w), ""), F.lit("Current turn:\n"), "content"))
        .filter("_own")
        .drop("_line", "_block", "_own", "pos")
    )


def session_counters(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max("created_at").alias("updated_at"))


def idle_vaults(sessions: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Whether each vault has been silent for ``minutes``."""
    newest = sessions.groupBy("vault").agg(F.max("updated_at").alias("newest"))
    quiet = clock.micros_between(F.col("newest"), clock.instant(as_of)) >= minutes * 60_000_000
    return newest.withColumn("idle", quiet)


def newest_update(df: DataFrame, group: str, key: str, at: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.max(at).alias("newest"),
        F.max_by(key, F.struct(at, key)).alias("newest_key"),
        F.min(at).alias("oldest"),
        F.min_by(key, F.struct(at, key)).alias("oldest_key"),
    )


def replay_schedule(sessions: DataFrame, as_of, n: int = 20, ratio: float = 0.3) -> DataFrame:
    """Sessions to replay per vault: mostly the newest, the rest the most important of
    the older ones (out of the newest ``4 n``). ``slot`` is the order of replay."""
    old = int(n * ratio)
    new = n - old
    days = F.greatest(clock.days_between(F.col("updated_at"), clock.instant(as_of)), F.lit(0.0))
    pool = skew.top_per_group(sessions, ["vault"], [F.desc("updated_at"), F.col("session_id")], 4 * n, "recency").withColumn(
        "importance", F.col("turn_count") + F.coalesce(1.0 / (1.0 + days), F.lit(0.0))
    )
    recent = pool.filter(F.col("recency") <= new).withColumn("slot", F.col("recency"))
    aged = skew.top_per_group(
        pool.filter(F.col("recency") > new), ["vault"], [F.desc("importance"), F.col("recency")], old, "_place"
    )
    return recent.unionByName(aged.withColumn("slot", F.col("_place") + new).drop("_place"))


def transcripts(turns: DataFrame, limit: int = 50) -> DataFrame:
    """Text of at most ``limit`` latest turns per session, oldest first."""
    role = F.when(F.coalesce("role", F.lit("")) == "", "user").otherwise(F.col("role"))
    body = text.squeeze(F.coalesce("content", F.lit("")))
    lines = last_n_turns(turns, limit).filter(body != "").select(
        "session_id", "turn_id", F.concat(role, F.lit(": "), body, F.lit("\n")).alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn_id", "line")))
    return lines.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("transcript"))


def consolidation_batch(sessions: DataFrame, turns: DataFrame, as_of, n: int = 20, ratio: float = 0.3, idle_minutes: int = 30, turn_limit: int = 50) -> DataFrame:
    """Transcripts to summarise: the replay batch of every idle vault."""
    idle = idle_vaults(sessions, as_of, idle_minutes).filter("idle").select("vault")
    batch = replay_schedule(sessions.join(idle, "vault", "left_semi"), as_of, n, ratio).select("vault", "session_id", "slot")
    wanted = turns.join(batch.select("session_id"), "session_id", "left_semi")
    return batch.join(transcripts(wanted, turn_limit), "session_id")


def gist_facts(gists: DataFrame, as_of, ttl_days: int = 365) -> DataFrame:
    """Facts to upsert from ``gists(vault, session_id, gist)``; the key makes a rerun
    overwrite, not add."""
    body = text.squeeze(F.col("gist"))
    now = clock.instant(as_of)
    return gists.filter(body != "").select(
        "vault",
        F.concat(F.lit("gist:"), "session_id").alias("fact_key"),
        body.alias("fact_value"),
        F.concat(F.lit("session:"), "session_id").alias("source"),
        F.lit("consolidation").alias("source_type"),
        F.lit("active").alias("status"),
        F.lit(0.7).alias("confidence"),
        F.lit("gist").alias("category"),
        "session_id",
        F.lit(ttl_days).alias("ttl_days"),
        now.alias("created_at"),
        now.alias("updated_at"),
        clock.plus_days(now, F.lit(ttl_days)).alias("expires_at"),
    )


def mark_finalized(sessions: DataFrame, turns: DataFrame, as_of) -> DataFrame:
    """Sessions with ``finalized_at``: those with turns get ``as_of`` unless they have one."""
    spoken = turns.select("session_id").distinct().withColumn("_at", clock.instant(as_of))
    had = F.col("finalized_at") if "finalized_at" in sessions.columns else F.lit(None)
    return sessions.join(spoken, "session_id", "left").withColumn("finalized_at", F.coalesce(had, "_at")).drop("_at")


def finalize(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Summary fact of each session and a fact per assistant turn with a decision."""
    low = F.lower("content")
    first_seen = [
        F.min_by("role", F.when(low.contains(w), F.col("turn_id"))).alias(f"_r{i}") for i, w in enumerate(TOPIC_WORDS)
    ]
    seen_at = [F.min(F.when(low.contains(w), F.col("turn_id"))).alias(f"_t{i}") for i, w in enumerate(TOPIC_WORDS)]
    per = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("content", "turn_id").alias("first"), *first_seen, *seen_at
    )

    def topics(user: bool) -> Column:
        hits = F.array(
            *[
                F.when(
                    F.col(f"_t{i}").isNotNull() & ((F.col(f"_r{i}") == "user") == F.lit(user)),
                    F.struct(F.col(f"_t{i}").alias("t"), F.lit(i).alias("i"), F.lit(w).alias("w")),
                )
                for i, w in enumerate(TOPIC_WORDS)
            ]
        )
        found = F.array_sort(F.filter(hits, lambda h: h.isNotNull()))
        return F.array_join(F.transform(found, lambda h: h["w"]), ", ")

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise("")

    owned = sessions.select("session_id", "vault", "agent_id").join(per, "session_id")
    summary = F.concat(
        F.lit("Session Summary\nSession: "), "session_id", F.lit("\nAgent: "), "agent_id", F.lit("\nTurns: "), F.col("n"), F.lit("\n"),
        line("User topics: ", topics(True)), line("Key aspects: ", topics(False)),
        F.lit("First topic: "), F.left("first", F.lit(200)), F.lit("\n"),
    )
    summaries = owned.select(
        "vault", F.concat(F.lit("session/"), "session_id", F.lit("/summary")).alias("fact_key"), summary.alias("fact_value"),
        F.lit("session_end").alias("source"), F.lit(0.7).alias("confidence"), F.array("agent_id", F.lit("session_summary")).alias("tags"),
    )
    said = turns.filter((F.col("role") == "assistant") & text.any_of(low, DECISION_PHRASES)).withColumn(
        "content",
        F.when(F.length("content") > 500, F.concat(F.left("content", F.lit(497)), F.lit("..."))).otherwise(F.col("content")),
    )
    slug = F.translate(F.lower(F.left("content", F.lit(48))), " .,:'\"", "-")
    decisions = said.join(sessions.select("session_id", "vault", "agent_id"), "session_id").select(
        "vault",
        F.concat(F.lit("house/decision/"), slug, F.lit("-"), F.substring(F.sha2("content", 256), 1, 8)).alias("fact_key"),
        F.col("content").alias("fact_value"), F.lit("session_end_auto").alias("source"), F.lit(0.6).alias("confidence"),
        F.array("agent_id", F.lit("auto_extracted")).alias("tags"),
    )
    decisions = skew.first_per_key(decisions, ["vault", "fact_key"], [F.col("tags")])
    return summaries.unionByName(decisions).withColumns({"source_type": F.lit("conversation"), "ttl_days": F.lit(365)})


def extracted_facts(parsed: DataFrame, facts: DataFrame, as_of, cap: float = 0.85, threshold: float = 0.85) -> DataFrame:
    """Facts of an extraction run that are to be written.

    ``parsed(vault, session_id, fact_key, value, confidence, category, ttl_days,
    embedding)``; near copies of an existing value are dropped, and a new value of an
    active key supersedes it.
    """
    now = clock.instant(as_of)
    judged = vector.dedup_against_existing(parsed, facts, threshold)
    return judged.filter(F.col("decision") != "skip").select(
        "vault",
        "fact_key",
        F.col("value").alias("fact_value"),
        F.least(F.col("confidence"), F.lit(cap)).alias("confidence"),
        "category",
        F.concat(F.lit("session:"), "session_id").alias("source"),
        F.lit("extraction").alias("source_type"),
        F.lit("active").alias("status"),
        F.when(F.col("decision") == "supersede", F.col("fact_key")).otherwise("").alias("supersedes"),
        "ttl_days",
        ff.expires_at(now, F.col("ttl_days")).alias("expires_at"),
        now.alias("created_at"),
    )


def conversation_facts(parsed: DataFrame, as_of) -> DataFrame:
    """Facts from ``parsing.json_facts`` of conversations, all up for review. ``n`` is
    the place of the fact in its answer and names facts that have no key."""
    now = clock.instant(as_of)
    unit = F.greatest(F.least(F.coalesce("confidence", F.lit(0.0)) / 10.0, F.lit(0.85)), F.lit(0.0))
    unnamed = F.concat(F.lit("conv-"), F.substring(F.sha2(F.col("conversation_id").cast("string"), 256), 1, 8), F.lit("-"), "n")
    return parsed.select(
        "conversation_id",
        F.when(ff.present(F.col("key")), F.col("key")).otherwise(unnamed).alias("fact_key"),
        F.col("value").alias("fact_value"),
        unit.alias("confidence"),
        "category",
        F.lit("needs_review").alias("status"),
        F.lit("conversation_extraction").alias("source_type"),
        F.when(F.col("ttl_days") > 0, F.col("ttl_days")).alias("ttl_days"),
        ff.expires_at(now, F.col("ttl_days")).alias("expires_at"),
        now.alias("created_at"),
    )
