"""Repeatable action sequences found in session turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import text
from loreweave.operators.sessions import BLOCK, placed
from loreweave.session import durable

MAX_GAP = 3
MIN_STEPS = 3
#: Names with a common word that one key takes, about.
WORD_NAMES = 2048

# What marks an action turn, and a good or bad outcome.
ACTION_WORDS = [
    "run", "check", "read", "write", "grep", "restart", "verify",
    "curl", "exec", "edit", "apply", "build", "test", "deploy",
    "fix", "install", "configure", "create", "update", "delete", "copy",
    "move", "start", "stop", "reload", "rebuild", "compile",
    "inspect", "examine", "search", "query", "fetch", "list",
    "step 1", "step 2", "step 3",
]
STEP_MARKS = [
    "step 1", "step 2", "step 3", "1. ", "2. ", "3. ",
    "first,", "second,", "third,", "first:", "second:", "third:",
]
POSITIVE = [
    "ok", "works", "resolved", "fixed", "pass", "success", "succeeded", "completed",
    "verified", "confirmed", "error resolved", "issue closed", "test passes",
]
NEGATIVE = [
    "failed", "error", "broken", "still broken", "not working", "not resolved",
    "still failing", "404", "500", "timeout", "unreachable", "unavailable",
]


def is_action(content: Column) -> Column:
    return text.any_of(F.lower(content), STEP_MARKS + ACTION_WORDS)


def marked_turns(turns: DataFrame) -> DataFrame:
    """What procedures need of each turn, with its position: flags and the two short
    lines, so no full text is shuffled. Written once and read by every step below."""
    low = F.lower("content")
    slim = turns.select(
        "session_id", "turn_id",
        ((F.col("role") == "assistant") & is_action(F.col("content"))).alias("action"),
        F.col("role").isin("user", "system").alias("listener"),
        text.any_of(low, NEGATIVE).alias("bad"), text.any_of(low, POSITIVE).alias("good"),
        step_text(F.col("content")).alias("step"), trigger_text(F.col("content")).alias("trigger"),
    )
    return durable(placed(slim))


def action_turns(marked: DataFrame) -> DataFrame:
    """Action turns with ``pos`` and the number ``run`` of their run in the session;
    a gap of more than three turns starts a new run."""
    actions = marked.filter("action")
    segment = F.floor(F.col("pos") / BLOCK)
    before = skew.neighbour(actions, ["session_id"], segment, [F.col("pos")], F.struct("pos"), "_before", ahead=False)
    fresh = F.when(F.col("_before").isNull() | (F.col("pos") - F.col("_before.pos") > MAX_GAP), 1).otherwise(0)
    return skew.running_sum(before, ["session_id"], segment, [F.col("pos")], fresh.cast("long"), "run").drop("_before")


def action_runs(actions: DataFrame) -> DataFrame:
    return actions.groupBy("session_id", "run").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n_actions")
    )


def with_outcome(runs: DataFrame, marked: DataFrame) -> DataFrame:
    """Add ``success``: the user or system says so within the two following turns, and
    nothing in them says otherwise."""
    marks = marked.filter("listener").select("session_id", "pos", "bad", "good")
    after = runs.select("session_id", "run", F.explode(F.array(F.col("last_pos") + 1, F.col("last_pos") + 2)).alias("pos"))
    judged = after.join(marks, ["session_id", "pos"]).groupBy("session_id", "run").agg(F.max("bad").alias("_bad"), F.max("good").alias("_good"))
    return (
        runs.join(judged, ["session_id", "run"], "left")
        .withColumn("success", F.coalesce(F.col("_good") & ~F.col("_bad"), F.lit(False)))
        .drop("_good", "_bad")
    )


def step_text(content: Column) -> Column:
    """The line of an action turn that states the step."""
    lines = F.transform(F.split(content, "\n"), text.squeeze)
    good = F.filter(
        lines, lambda x: ~x.startswith("#") & ~x.startswith("//") & (F.length(x) > 5) & (F.length(x) < 200)
    )
    spare = F.filter(lines, lambda x: F.length(x) > 5)
    return F.coalesce(F.get(good, F.lit(0)), F.get(spare, F.lit(0)), text.truncate(content, 200))


def summarize_step(step: Column) -> Column:
    """Up to four words from the first action word on, else the first five words."""

    def pick(words: Column) -> Column:
        hits = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))),
            lambda i: (i < F.size(words) - 1) & text.any_of(F.lower(F.get(words, i)), ACTION_WORDS),
        )
        at = F.get(hits, F.lit(0))
        chosen = F.when(at.isNotNull(), F.slice(words, F.coalesce(at, F.lit(0)) + 1, F.lit(4))).otherwise(
            F.slice(words, F.lit(1), F.lit(5))
        )
        return text.truncate(F.array_join(chosen, " "), 60)

    bare = F.regexp_replace(step, "^`+|`+$", "")
    return text.let(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), pick)


def trigger_text(content: Column) -> Column:
    lines = F.transform(F.split(content, "\n"), text.squeeze)
    good = F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200))
    return F.coalesce(F.get(good, F.lit(0)), text.truncate(content, 200))


def procedure_key(name: Column, trigger: Column) -> Column:
    return F.concat(F.lit("procedure-"), F.substring(F.sha2(F.concat(name, F.lit("\0"), trigger), 256), 1, 12))


def procedure_steps(marked: DataFrame) -> DataFrame:
    """Steps of every run, one row each, ordered by ``pos``."""
    return action_turns(marked).select("session_id", "run", "pos", "step").filter(F.col("step") != "")


def procedures(turns: DataFrame, min_steps: int = MIN_STEPS) -> DataFrame:
    """Successful runs of at least ``min_steps`` actions, named by their first two
    steps and the turn before them. The steps stay a table of their own."""
    marked = marked_turns(turns)
    actions = durable(action_turns(marked).select("session_id", "run", "pos", "step"))
    runs = with_outcome(action_runs(actions).filter(F.col("n_actions") >= min_steps), marked).filter("success")
    steps = actions.filter(F.col("step") != "").join(runs.select("session_id", "run"), ["session_id", "run"], "left_semi")
    counts = steps.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n_steps"))
    leading = skew.top_per_group(steps, ["session_id", "run"], [F.col("pos")], 2, "_no").groupBy("session_id", "run").agg(
        F.max(F.when(F.col("_no") == 1, summarize_step(F.col("step")))).alias("_one"),
        F.max(F.when(F.col("_no") == 2, summarize_step(F.col("step")))).alias("_two"),
    )
    before = marked.select("session_id", (F.col("pos") + 1).alias("first_pos"), F.col("trigger").alias("_trigger"))
    more = F.concat(F.lit(" and "), F.lower(F.left("_two", F.lit(30))))
    name = F.concat("_one", F.when(F.col("_two").isNotNull() & (F.col("_two") != F.col("_one")), more).otherwise(""))
    trigger = F.when(F.coalesce("_trigger", F.lit("")) == "", "Agent initiated action sequence").otherwise(F.col("_trigger"))
    return (
        runs.join(counts, ["session_id", "run"])
        .filter(F.col("n_steps") >= MIN_STEPS)
        .join(leading, ["session_id", "run"])
        .join(before, ["session_id", "first_pos"], "left")
        .withColumns({"name": name, "trigger": trigger})
        .withColumn("key", procedure_key(F.col("name"), F.col("trigger")))
        .select("key", "name", "trigger", "session_id", "run", "first_pos", "last_pos", "n_steps", F.lit(1).alias("success_count"))
    )


# ── duplicate procedures ──────────────────────────────────────────────────────
def _bigrams(name: Column) -> Column:
    last = F.length(name) - 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(name, i, F.lit(2)))).otherwise(
        F.array().cast("array<string>")
    )


def name_similarity(a: Column, b: Column) -> Column:
    """0.6 word overlap + 0.4 letter-pair overlap, plus 0.15 for the same action word."""

    def score(s: Column) -> Column:
        wa, wb, ga, gb = s["wa"], s["wb"], s["ga"], s["gb"]
        shared = F.size(F.filter(wb, lambda w: F.array_contains(wa, w)))
        union = F.size(wa) + F.size(wb) - shared
        words = F.when(union > 0, shared / union).otherwise(0.0)
        pairs = F.aggregate(
            F.array_intersect(ga, gb),
            F.lit(0),
            lambda n, g: n + F.least(F.size(F.filter(ga, lambda x: x == g)), F.size(F.filter(gb, lambda x: x == g))),
        )
        letters = F.when((F.size(ga) > 0) & (F.size(gb) > 0), 2 * pairs / (F.size(ga) + F.size(gb))).otherwise(0.0)
        verbs = [F.get(F.filter(w, lambda x: x.isin(ACTION_WORDS)), F.lit(0)) for w in (wa, wb)]
        bonus = F.when(verbs[0] == verbs[1], 0.15).otherwise(0.0)
        return F.least(F.lit(1.0), words * 0.6 + letters * 0.4 + bonus)

    def words_of(n: Column) -> Column:
        return F.filter(F.split(n, r"\s+"), lambda w: w != "")

    packed = F.struct(words_of(a).alias("wa"), words_of(b).alias("wb"), _bigrams(a).alias("ga"), _bigrams(b).alias("gb"))
    empty = (text.word_count(a) == 0) | (text.word_count(b) == 0)
    return F.when(a == b, 1.0).when(empty, 0.0).otherwise(text.let(packed, score))


def _numbered_bigrams(name: Column) -> Column:
    """Letter pairs as numbers, equal ones told apart by their place among equals, so
    that the numbers two names share are as many as the letter pairs they share."""

    def numbered(pairs: Column) -> Column:
        place = lambda g, i: F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g))
        return F.transform(pairs, lambda g, i: F.ascii(g).cast("long") * (1 << 42) + F.ascii(F.substr(g, F.lit(2))).cast("long") * (1 << 21) + place(g, i))

    return text.let(_bigrams(name), numbered)


def dedup_procedures(new: DataFrame, old: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Per new name the most similar old procedure at or above ``threshold``, if any.

    Only distinct names are compared, in two ways. Names of the same letter pairs meet
    by these. For all others the letter overlap is at most 1 - 1 / (letter pairs of
    both), so to reach a threshold t the word overlap must be at least some j > 0, and
    names of m and n words share at least j / (1 + j) * (m + n) of them. With the words
    of a name from the rarest on, the rarest shared one stands so early in both names
    that as many may follow; names meet by such words only, and only by the rarest they
    share; a word of many names is dealt over several keys. Pairs whose shared words and
    letter pairs leave the threshold out of reach go before the similarity is taken.
    Thresholds that need no shared word at all are refused.
    """
    if threshold - 1e-6 <= 0.55:
        raise ValueError("threshold must be above 0.55")

    def clean(c: str) -> Column:
        return F.lower(text.squeeze(F.col(c)))

    def split(c: str) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    asked = new.select(clean("name").alias("name")).distinct()
    asked = durable(asked.withColumn("_ga", _numbered_bigrams(F.col("name"))))
    held = old.groupBy(clean("name").alias("old_name")).agg(F.min("key").alias("existing_key")).filter(F.col("old_name") != "")
    held = durable(held.withColumn("_gb", _numbered_bigrams(F.col("old_name"))))

    def shapes(df: DataFrame, name: str) -> tuple[int, list]:
        """Length of the longest name, and each number of words and of repeated ones."""
        n = F.size(split(name))
        found = df.select(F.length(name).alias("l"), n.alias("n"), (n - F.size(F.array_distinct(split(name)))).alias("more"))
        rows = found.groupBy("n", "more").agg(F.max("l").alias("l")).collect()
        return max([r["l"] for r in rows], default=1), [(r["n"], r["more"]) for r in rows]

    longest_new, new_shapes = shapes(asked, "name")
    longest_old, old_shapes = shapes(held, "old_name")
    letters = 1.0 - 1.0 / max(longest_new + longest_old, 1)
    j = (threshold - 1e-6 - 0.15 - 0.4 * letters) / 0.6
    need = F.greatest(F.ceil((F.col("_m") + F.col("_n")) * (j / (1.0 + j)) - 1e-9), F.lit(1)).cast("int").alias("_need")

    def each(values: list, names: list[str]) -> Column:
        rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(row, names)]) for row in values]
        return F.inline(F.array(*rows) if rows else F.array().cast(f"array<struct<{','.join(f'{c}:int' for c in names)}>>"))

    index = asked.select("name", "_ga", F.size(split("name")).alias("_m"), F.explode(F.array_distinct(split("name"))).alias("word"))
    common = index.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    early = F.col("_u") + F.col("_more") - F.col("_need") + 1
    deals = F.ceil(F.col("_x._df") / WORD_NAMES).cast("int")
    index = (
        index.join(common, "word").groupBy("name", "_m").agg(F.array_sort(F.collect_list(F.struct("_df", "word"))).alias("_w"), F.first("_ga").alias("_ga"))
        .select("name", "_ga", "_m", "_w", F.size("_w").alias("_u"), each(old_shapes, ["_n", "_more"])).select("*", need)
        .filter((early >= 1) & (F.col("_need") <= F.col("_n")))
        .select("name", "_ga", "_m", F.col("_w.word").alias("_wa"), "_n", "_more", F.explode(F.slice("_w", 1, F.least(early, F.col("_u")))).alias("_x"))
        .select("name", "_ga", "_m", "_wa", "_n", "_more", F.col("_x.word").alias("word"), F.pmod(F.xxhash64("name"), deals).cast("int").alias("_deal"))
    )
    rare_first = F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "word", "_i")))
    probes = (
        held.select("old_name", "_gb", F.posexplode(split("old_name")).alias("_i", "word")).join(common, "word", "left")
        .groupBy("old_name").agg(rare_first.alias("_w"), F.first("_gb").alias("_gb"))
        .select("old_name", "_gb", F.transform("_w", lambda x: F.struct(x["_df"].alias("_df"), x["word"].alias("word"))).alias("_w"), each(sorted({(m,) for m, _ in new_shapes}), ["_m"]))
        .select("*", F.size("_w").alias("_n"), (F.size("_w") - F.size(F.array_distinct("_w"))).alias("_more")).select("*", need)
        .filter(F.col("_need") <= F.col("_n"))
        .select("old_name", "_gb", F.col("_w.word").alias("_wb"), "_n", "_more", "_m", "_need",
                F.explode(F.array_distinct(F.slice("_w", 1, F.col("_n") - F.col("_need") + 1))).alias("_x"))
        .filter("_x._df > 0")
        .select("old_name", "_gb", "_wb", "_n", "_more", "_m", "_need", F.col("_x.word").alias("word"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("_deal"))
    )
    shared = F.array_intersect("_wa", "_wb")
    most = F.least(F.size(shared) + F.col("_more"), F.col("_n"))
    of_letters = F.size("_ga") + F.size("_gb")
    reached = most / (F.col("_m") + F.col("_n") - most) * 0.6 + F.when(of_letters > 0, 2 * F.size(F.array_intersect("_ga", "_gb")) / of_letters).otherwise(0.0) * 0.4 + 0.15
    met = (
        probes.join(index, ["word", "_deal", "_m", "_n", "_more"])
        .filter((most >= F.col("_need")) & (F.get(shared, F.lit(0)) == F.col("word")))
        .filter(reached >= threshold - 1e-6)
        .select("name", "old_name")
    )

    def by_letters(df: DataFrame, name: str, letters: str) -> DataFrame:
        same = F.when(F.length(name) < 2, F.xxhash64(name)).otherwise(F.xxhash64(F.array_sort(letters)))
        return df.select(name, same.alias("_letters"))

    pairs = met.unionByName(by_letters(asked, "name", "_ga").join(by_letters(held, "old_name", "_gb"), "_letters").select("name", "old_name")).distinct()
    scored = pairs.withColumn("similarity", F.round(name_similarity(F.col("name"), F.col("old_name")), 6)).filter(
        F.col("similarity") >= threshold
    )
    best = scored.join(held.drop("_gb"), "old_name").groupBy("name").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("existing_key", F.struct("similarity", "existing_key")).alias("existing_key"),
    )
    return new.withColumn("_name", clean("name")).join(best.withColumnRenamed("name", "_name"), "_name", "left").drop("_name").withColumn(
        "decision", F.when(F.col("existing_key").isNotNull(), "update").otherwise("create")
    )


def merge_procedures(old: DataFrame, judged: DataFrame) -> DataFrame:
    """Next procedure table: matched ones count one more success per match, the rest
    is added."""
    hits = judged.filter(F.col("decision") == "update").groupBy(F.col("existing_key").alias("key")).agg(F.count(F.lit(1)).alias("_n"))
    kept = old.join(hits, "key", "left").withColumn("success_count", F.col("success_count") + F.coalesce("_n", F.lit(0))).drop("_n")
    born = judged.filter(F.col("decision") == "create").groupBy("key", "name", "trigger").agg(F.count(F.lit(1)).alias("success_count"))
    return kept.select("key", "name", "trigger", "success_count").unionByName(
        born.join(old.select("key"), "key", "left_anti").select("key", "name", "trigger", "success_count")
    )
