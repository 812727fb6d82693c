"""Procedure names are matched as by comparing all of them, without meeting by a common word alone."""

import random

from pyspark.sql import functions as F

from loreweave.operators import procedures as pr


def _names(spark, seed, n):
    rng = random.Random(seed)
    words = ["check", "run", "the", "a", "log", "logs", "build", "of", "test", "tests"] + [f"w{i}" for i in range(30)]
    rows = [(f"{seed}/{i}", " ".join(["Check"] + rng.choices(words, k=rng.randrange(0, 6))), "t") for i in range(n - 1)] + [(f"{seed}/x", "x", "t")]
    return spark.createDataFrame(rows, "key string, name string, trigger string")


def test_matches_are_those_of_all_pairs(spark):
    new, old = _names(spark, 1, 250), _names(spark, 2, 250)
    for threshold in (0.6, 0.7, 0.85):
        got = pr.dedup_procedures(new, old, threshold).select("key", "similarity", "existing_key", "decision").collect()
        a, b = new.select("key", F.lower("name").alias("a")), old.select(F.col("key").alias("k"), F.lower("name").alias("b"))
        b = b.groupBy("b").agg(F.min("k").alias("k"))
        all_ = a.crossJoin(b).withColumn("s", F.round(pr.name_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("s") >= threshold)
        want = {r["key"]: (r["s"], r["k"]) for r in all_.groupBy("key").agg(F.max("s").alias("s"), F.max_by("k", F.struct("s", "k")).alias("k")).collect()}
        assert {r["key"]: (r["similarity"], r["existing_key"]) for r in got if r["decision"] == "update"} == want
        assert len(got) == 250


def test_a_word_of_every_name_pairs_no_long_names(spark, monkeypatch):
    """Names of five words that share only the first are never compared."""
    new = spark.createDataFrame([(f"n{i}", f"check a{i} b{i} c{i} d{i}", "t") for i in range(50)], "key string, name string, trigger string")
    old = spark.createDataFrame([(f"o{i}", f"check e{i} f{i} g{i} h{i}", "t") for i in range(50)], "key string, name string, trigger string")
    compared = []

    def failing(a, b):
        compared.append(1)
        return F.raise_error(F.lit("compared")).cast("double")

    monkeypatch.setattr(pr, "name_similarity", failing)
    out = pr.dedup_procedures(new, old, 0.7)
    assert compared and out.filter("decision = 'create'").count() == 50


def test_common_words_pair_only_names_that_share_enough(spark, monkeypatch):
    """Names that share two common words of five, or three and few letters, are not compared; repeated words and names of the same letter pairs are."""
    new = [(f"n{i}", f"check the {a}{a}{a} {b}{b} {a}{b}{a}{b}", "t") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "ijklmnop")]
    old = [(f"o{i}", f"check the {a}{a}{a} {b}{b} {a}{b}{a}{b}", "t") for i, (a, b) in enumerate((a, b) for a in "qrstuv" for b in "wxyz")]
    make = lambda rows: spark.createDataFrame(rows, "key string, name string, trigger string")
    with monkeypatch.context() as m:
        m.setattr(pr, "name_similarity", lambda a, b: F.raise_error(F.concat(a, b)).cast("double"))
        assert pr.dedup_procedures(make(new), make(old), 0.7).filter("decision = 'create'").count() == len(new)
    monkeypatch.setattr(pr, "WORD_NAMES", 7)  # common words over several keys
    extra = [("p0", "check the the the build", "t"), ("p1", "check the log of tests", "t"), ("p2", "x", "t"), ("p3", "", "t"), ("p4", "run 😀😀 é logs", "t")]
    held = [("q0", "check the the the guild", "t"), ("q1", "check of the log tests", "t"), ("q2", "y", "t"), ("q3", "x", "t"), ("q4", "run 😀😀 é log", "t"), ("q5", "check the build the the", "t")]
    got = pr.dedup_procedures(make(new + extra), make(old + held), 0.7).filter("key like 'p%'").collect()
    assert {r["key"]: r["existing_key"] for r in got} == {"p0": "q5", "p1": "q1", "p2": "q3", "p3": None, "p4": "q4"}
