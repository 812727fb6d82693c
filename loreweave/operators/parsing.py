"""Model answers and free text to structured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import text

FACT_SCHEMA = "array<struct<key:string,value:string,confidence:double,category:string,ttl_days:int>>"
GRAPH_SCHEMA = (
    "struct<entities:array<struct<name:string,kind:string>>,"
    "relations:array<struct<source:string,target:string,type:string,fact:string>>>"
)

# Phrase patterns of durable statements and their domain, in order.
FACT_TRIGGERS = [
    (r"\bwe (?:decided|agreed|concluded|will use|chose)\b", "decision"),
    (r"\bdecision\b", "decision"),
    (r"\bagreed\b", "decision"),
    (r"\bconclusion\b", "conclusion"),
    (r"\bthe (?:plan|approach|strategy) (?:is|will be)\b", "approach"),
    (r"\bplan\b", "approach"),
    (r"\bconfig(?:ure|uration)?\b", "config"),
    (r"\bset (?:the )?.+? to\b", "config"),
    (r"\benv(?:ironment)? var(?:iable)?\b", "config"),
    (r"\bprefer(?:ence)?\b", "preference"),
    (r"\bstandard\b", "preference"),
    (r"\bshould (?:always )?use\b", "preference"),
    (r"\balways use\b", "preference"),
]


def clean_line(line: Column) -> Column:
    """Drop list markers, quotes and outer white space."""
    numbered = F.regexp_replace(text.squeeze(line), r"^[0-9]{1,3}[.)]\s*", "")
    bulleted = F.regexp_replace(numbered, r"^[-*•\s]+", "")
    return text.squeeze(F.regexp_replace(bulleted, "^[\"']+|[\"']+$", ""))


def list_lines(answer: Column) -> Column:
    """Cleaned, non-empty lines, each once regardless of case, in order."""
    def once(lines: Column) -> Column:
        return text.let(
            F.transform(lines, F.lower),
            lambda folded: F.transform(
                F.array_distinct(folded), lambda low: F.element_at(lines, F.array_position(folded, low).cast("int"))
            ),
        )

    return text.let(F.filter(F.transform(F.split(answer, "\n"), clean_line), lambda x: x != ""), once)


def first_line(answer: Column) -> Column:
    return F.coalesce(F.get(list_lines(answer), F.lit(0)), F.lit(""))


def rank_order(answer: Column, n: Column) -> Column:
    """Positions 1..n named in the answer, each once, in order."""
    numbers = F.transform(F.split(answer, r"[, \n\t\[\].]+"), lambda p: p.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda v: v.isNotNull() & (v >= 1) & (v <= n)))


def json_facts(answers: DataFrame, answer: str = "answer", fallback: bool = True) -> DataFrame:
    """One row per fact of a JSON answer.

    An answer that is not such JSON gives one summary fact with confidence 5 (or no
    row at all when ``fallback`` is false).
    """
    bare = text.strip_fences(F.col(answer))
    parsed = F.when(bare.startswith("[") & bare.endswith("]"), F.from_json(bare, FACT_SCHEMA))
    digest = F.substring(F.sha2(F.col(answer), 256), 1, 8)
    spare = F.array(
        F.struct(
            F.concat(F.lit("conversation-summary-"), digest).alias("key"),
            F.col(answer).alias("value"),
            F.lit(5.0).alias("confidence"),
            F.lit(None).cast("string").alias("category"),
            F.lit(None).cast("int").alias("ttl_days"),
        )
    )
    facts = F.coalesce(parsed, spare) if fallback else parsed
    rest = [c for c in answers.columns if c != answer]
    return answers.select(*rest, F.posexplode(facts).alias("n", "f")).select(*rest, "n", "f.*")


def graph_json(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Parse graph answers into ``entities`` and ``relations`` columns; NULL when corrupt."""
    parsed = F.from_json(text.strip_fences(F.col(answer)), GRAPH_SCHEMA)
    rest = [c for c in answers.columns if c != answer]
    return answers.select(*rest, parsed.alias("_g")).select(*rest, "_g.entities", "_g.relations")


def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Cited chunks of each answer, in order of first mention.

    ``answers(answer_id, text)`` and ``context(answer_id, chunk_id, …)``; unknown ids
    and ``none`` are dropped.
    """
    marks = F.regexp_extract_all("text", F.lit(r"\[cite:\s*([^\]]+)\]"), F.lit(1))
    ids = F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, ","))), text.squeeze)
    named = (
        answers.select("answer_id", F.posexplode(ids).alias("pos", "chunk_id"))
        .filter((F.col("chunk_id") != "") & (F.lower("chunk_id") != "none"))
        .groupBy("answer_id", "chunk_id")
        .agg(F.min("pos").alias("pos"))
    )
    return named.join(context, ["answer_id", "chunk_id"])


def fact_domain(sentence: Column) -> Column:
    """Domain of a sentence that states something durable, else NULL."""
    low = F.lower(sentence)
    domain = F.lit(None).cast("string")
    for pattern, name in reversed(FACT_TRIGGERS):
        domain = F.when(low.rlike(pattern), name).otherwise(domain)
    return F.when(~sentence.contains("?") & (text.word_count(sentence) >= 4), domain)


def sentence_facts(turns: DataFrame, prefix: str = "session-facts") -> DataFrame:
    """Durable sentences of the turns as facts; the key is made from the text, so the
    same sentence said again lands on the same key (first turn kept)."""
    parts = F.transform(F.split("content", r"(?<=[.!?])\s+|\n+"), text.squeeze)
    said = (
        turns.select("session_id", "turn_id", F.posexplode(parts).alias("pos", "value"))
        .filter(F.col("value") != "")
        .withColumn("domain", fact_domain(F.col("value")))
        .filter(F.col("domain").isNotNull())
    )
    value = F.when(F.length("value") > 500, F.concat(F.left("value", F.lit(497)), F.lit("..."))).otherwise(F.col("value"))
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower("value"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(48))
    keyed = said.withColumn("value", value).withColumn(
        "fact_key",
        F.concat(
            F.lit(prefix + "/"), "domain", F.lit("/"), F.when(slug == "", "item").otherwise(slug), F.lit("-"),
            F.substring(F.sha2("value", 256), 1, 8),
        ),
    )
    return skew.first_per_key(keyed, ["fact_key"], [F.col("session_id"), F.col("turn_id"), F.col("pos")])
