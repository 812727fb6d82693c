"""Benchmark conversations, questions and result traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave import schemas
from loreweave.functions import text

# Question categories and the words that hint at a question's type.
LOCOMO_CATEGORIES = {1: "single-hop", 2: "temporal-reasoning", 3: "multi-hop", 4: "open-domain"}
TEMPORAL_WORDS = ["before", "after", "how many", "how long", "when"]
RETRIEVAL_WORDS = ["what did", "what was", "who", "which"]
STORY_TYPES = [
    ("character", ["who", "whose", "which character", "what is the name of the"]),
    ("setting", ["where", "in what place", "what city", "what country", "what town"]),
    ("temporal", ["when", "what year", "what time", "what date", "how long"]),
    ("cause", ["why", "what caused", "what reason"]),
    ("method", ["how", "by what means", "in what way"]),
]

MESSAGE = "struct<role:string,content:string>"
LOCOMO_SCHEMA = (
    "sample_id string, conversation map<string,string>, "
    "qa array<struct<question:string,answer:string,category:int>>"
)


# ── LoCoMo ────────────────────────────────────────────────────────────────────
def load_locomo(spark: SparkSession, path: str, vault: str = "locomo-v1", config: str = "D") -> tuple[DataFrame, DataFrame]:
    """Messages and questions of a LoCoMo file (a JSON array of samples).

    Sessions ``session_1, session_2, …`` are read up to the first missing number and
    flattened in order; messages without text are dropped.
    """
    raw = spark.read.schema(LOCOMO_SCHEMA).option("multiLine", "true").json(path)
    number = F.regexp_extract("key", r"^session_(\d+)$", 1).try_cast("int")
    sessions = raw.select("sample_id", F.explode("conversation").alias("key", "value")).withColumn("session", number).filter("session is not null")
    # A gap ends the list: keep numbers n for which all of 1..n exist.
    kept = raw.select(
        "sample_id",
        F.array_sort(F.filter(F.transform(F.map_keys("conversation"), lambda k: F.regexp_extract(k, r"^session_(\d+)$", 1).try_cast("int")), lambda n: n.isNotNull())).alias("_n"),
    ).select("sample_id", F.size(F.filter("_n", lambda n, i: n == i + 1)).alias("last"))
    spoken = F.from_json("value", "array<struct<speaker:string,text:string>>")
    messages = (
        sessions.join(kept, "sample_id").filter(F.col("session") <= F.col("last"))
        .select("sample_id", "session", F.posexplode(spoken).alias("pos", "m"))
        .filter(F.coalesce("m.text", F.lit("")) != "")
        .select(
            F.col("sample_id").alias("conversation_id"), "session", "pos", F.coalesce("m.speaker", F.lit("user")).alias("speaker"),
            F.when(F.coalesce("m.speaker", F.lit("user")).isin("user", "Human"), "user").otherwise("assistant").alias("role"),
            F.col("m.text").alias("content"), F.lit(vault).alias("vault"), F.concat(F.lit("locomo/"), "sample_id").alias("source"),
        )
    )
    names = F.create_map(*[F.lit(x) for kv in LOCOMO_CATEGORIES.items() for x in kv])
    category = F.coalesce("q.category", F.lit(0))
    spoke = messages.select(F.col("conversation_id").alias("sample_id")).distinct()
    questions = (
        raw.join(spoke, "sample_id", "left_semi")
        .select("sample_id", F.posexplode("qa").alias("i", "q"))
        .filter(F.coalesce("q.question", F.lit("")) != "")
        .select(
            F.concat(F.lit("locomo-"), "sample_id", F.lit("-"), "i").alias("question_id"), F.lit("locomo").alias("benchmark"), F.lit(config).alias("config"),
            F.coalesce(names[category], F.concat(F.lit("category-"), category)).alias("question_type"), F.col("q.question").alias("question"),
            F.coalesce("q.answer", F.lit("")).alias("ground_truth"), F.col("sample_id").alias("conversation_id"),
        )
    )
    return messages, questions


# ── LongMemEval ───────────────────────────────────────────────────────────────
def infer_question_type(known: Column, question: Column) -> Column:
    low = F.lower(question)
    given = F.replace(F.lower(known), F.lit(" "), F.lit("-"))
    return (
        F.when(F.coalesce(known, F.lit("")) != "", given)
        .when(text.any_of(low, TEMPORAL_WORDS), "temporal-reasoning")
        .when(text.any_of(low, RETRIEVAL_WORDS), "fact-retrieval")
        .otherwise("unknown")
    )


def _session_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(f"{path.rstrip('/')}/S", wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_path", r"/S/([^/]+)/[^/]+$", 1).alias("conversation_id"), text.squeeze(F.col("value")).alias("body"))


def load_longmemeval(spark: SparkSession, path: str, vault: str = "longmemeval-v1", config: str = "D") -> tuple[DataFrame, DataFrame]:
    """Messages and questions of ``S/<session>/{conversation,questions}.json``.

    A conversation is a list of messages, an object holding such a list, or a single
    message; a question file is a list or one question. A question id counts once.
    """
    talks = _session_files(spark, path, "conversation.json")
    listed = F.from_json("body", f"array<{MESSAGE}>")
    boxed = F.from_json("body", f"struct<messages:array<{MESSAGE}>,conversation:array<{MESSAGE}>,turns:array<{MESSAGE}>,role:string,content:string>")
    single = F.when(boxed["role"].isNotNull(), F.array(F.struct(boxed["role"].alias("role"), boxed["content"].alias("content"))))
    both = F.when(F.startswith("body", F.lit("[")), listed).otherwise(F.coalesce(boxed["messages"], boxed["conversation"], boxed["turns"], single))
    messages = talks.select("conversation_id", F.posexplode(both).alias("pos", "m")).select(
        "conversation_id", "pos", "m.role", "m.content", F.lit(vault).alias("vault"), F.concat(F.lit("longmemeval/"), "conversation_id").alias("source")
    )
    asked = _session_files(spark, path, "questions.json").withColumn(
        "body", F.when(F.startswith("body", F.lit("[")), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    )
    shape = "array<struct<question_id:string,question:string,text:string,type:string,category:string,answer:string,ground_truth:string>>"
    q = asked.select("conversation_id", F.posexplode(F.from_json("body", shape)).alias("i", "q"))
    wording = F.coalesce("q.question", "q.text", F.lit(""))
    questions = (
        q.filter((F.coalesce("q.question_id", F.lit("")) != "") & (wording != ""))
        .groupBy("q.question_id")
        .agg(F.min_by(F.struct("q", "conversation_id"), F.struct("conversation_id", "i")).alias("f"))
        .select("f.q", "f.conversation_id")
    )
    return messages, questions.select(
        F.concat(F.lit("lme-"), "q.question_id").alias("question_id"), F.lit("longmemeval").alias("benchmark"), F.lit(config).alias("config"),
        infer_question_type(F.coalesce("q.type", "q.category"), wording).alias("question_type"), wording.alias("question"),
        F.coalesce("q.answer", "q.ground_truth", F.lit("")).alias("ground_truth"), "conversation_id",
    )


def split_by_conversation(conversations: DataFrame, path: str) -> int:
    """One folder per conversation id, skipping ids that are already there.

    ``conversations(conv_id, …)``; returns the number of new conversations.
    """
    spark = conversations.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = conversations
    if fs.exists(target):
        known = spark.read.schema(conversations.schema).json(path).select("conv_id").distinct()
        fresh = conversations.join(known, "conv_id", "left_anti")
    n = fresh.select("conv_id").distinct().count()
    fresh.write.mode("append").partitionBy("conv_id").json(path)
    return n


# ── NarrativeQA ───────────────────────────────────────────────────────────────
def classify_story_question(question: Column) -> Column:
    low = F.lower(question)
    out = F.when(low.startswith("what") | low.contains("what happened"), "plot").otherwise("comprehension")
    for name, words in reversed(STORY_TYPES):
        out = F.when(text.any_of(low, words), name).otherwise(out)
    return out


def load_narrativeqa(rows: DataFrame, kinds: list[str] | None = None, max_words: int = 0, prefix: str = "nqa", shared_vault: bool = False, config: str = "D") -> tuple[DataFrame, DataFrame]:
    """Stories and questions from rows ``(document, question, answers)``.

    Stories of another kind, too long or empty are dropped; a story has a vault of its
    own unless ``shared_vault``. Reference answers are joined with `` | ``.
    """
    d = F.col("document")
    kind = F.lower(F.coalesce(d["kind"], F.lit("")))
    body = text.squeeze(F.coalesce(d["text"], F.lit("")))
    keep = body != ""
    if kinds:
        keep = keep & ((kind == "") | kind.isin(kinds))
    if max_words:
        keep = keep & (F.coalesce(d["word_count"].cast("int"), F.lit(0)) <= max_words)
    wanted = rows.filter(keep)
    safe = F.regexp_replace(F.left(d["id"], F.lit(8)), "[^A-Za-z0-9_-]", "")
    own = F.concat(F.lit(prefix + "-"), F.when(kind == "", "doc").otherwise(kind), F.lit("-"), safe)
    stories = wanted.groupBy(d["id"].alias("conversation_id")).agg(
        F.min(body).alias("content"), F.min(F.lit(f"{prefix}-shared") if shared_vault else own).alias("vault"),
        F.min(F.concat(F.lit("narrativeqa/"), kind, F.lit("/"), d["id"])).alias("source"),
    )
    asked = text.squeeze(F.coalesce(F.col("question")["text"], F.lit("")))
    answers = F.filter(F.transform("answers", lambda a: text.squeeze(a["text"])), lambda a: F.coalesce(a, F.lit("")) != "")
    questions = wanted.filter(asked != "").select(
        F.concat(F.lit("nqa-"), d["id"], F.lit("-"), F.substring(F.sha2(asked, 256), 1, 8)).alias("question_id"), F.lit("narrativeqa").alias("benchmark"),
        F.lit(config).alias("config"), classify_story_question(asked).alias("question_type"), asked.alias("question"),
        F.array_join(answers, " | ").alias("ground_truth"), d["id"].alias("conversation_id"),
    )
    return stories, questions.dropDuplicates(["question_id"])


# ── traces ────────────────────────────────────────────────────────────────────
def write_traces(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.TRACES).json(path)
    return rows.withColumn("question_type", F.coalesce("question_type", F.lit("unknown"))).withColumn("retries", F.coalesce("retries", F.lit(0)))
