"""Phrases in texts: one look against one pattern each, and the join against both."""

import random
import re

from pyspark.sql import functions as F

from storyflow.operators import classify, filters, phrases

WORDS = ["fire", "fires", "fire service", "fire service staff", "new", "new york", "york", "a-b", "a", "b", "café", "it's", "o'clock", "c++", ".net", "x y z", "x y", "y z"]


def texts():
    rnd = random.Random(3)
    parts = ["fire", "service", "staff", "new", "york", "a", "b", "café", "it's", "o'clock", "c++", ".net", "x", "y", "z", "cafés", "firex"]
    return [None, "", " "] + ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "-", ", ", "  ", ""]) for _ in range(rnd.randrange(1, 14))) for _ in range(300)]


def test_one_look_finds_what_a_pattern_each_finds(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    got = df.select("i", F.array_sort(classify.keywords_in(F.coalesce("t", F.lit("")), WORDS)).alias("k")).collect()
    for r in got:
        assert r["k"] == sorted(w for w in WORDS if re.search(rf"(?<!\w){re.escape(w)}(?!\w)", rows[r["i"]] or "")), rows[r["i"]]


PLACES = ("Barton", "Barton upon Humber", "Sutton-on-Sea", "Sutton", "Sutton on", "St. Ives", "Market Rasen", "Rasen", "York")


def test_places_in_one_look(spark):
    rnd = random.Random(4)
    parts = ["Barton", "upon", "HUMBER", "Sutton", "on", "Sea", "St.", "Ives", "market", "Rasen", "York", "Yorkshire", "x"]
    rows = [None, ""] + ["".join(rnd.choice(parts) + rnd.choice([" ", "-", " - ", "\n", ", ", ""]) for _ in range(rnd.randrange(1, 10))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    names = sorted(PLACES, key=lambda p: (-len(p), p))
    for r in df.select("i", filters.matched_places("t", PLACES).alias("k")).collect():
        assert r["k"] == [p for p in names if re.search(filters.place_pattern(p), rows[r["i"]] or "", re.I)], rows[r["i"]]


def test_the_join_finds_the_same_and_takes_a_large_table(spark):
    plain = [w for w in WORDS if re.match(r"[a-zé]+( [a-zé]+)*\Z", w)]
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    words = F.filter(F.split(F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)[^\w ]+", " ¦ "), " +"), lambda w: w != "")
    table = spark.createDataFrame([(p,) for p in plain], "phrase string").withColumn("words", F.split("phrase", " "))
    found = {}
    for r in phrases.matches(df, "i", words, table).collect():
        found.setdefault(r["i"], []).append(r["phrase"])
    row = df.select("i", F.array_sort(phrases.found_in(F.array_join(words, " "), plain)).alias("k")).collect()
    assert {r["i"]: r["k"] for r in row if r["k"]} == {i: sorted(k) for i, k in found.items()}
    many = table.unionByName(spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x")).alias("phrase")).withColumn("words", F.split("phrase", " ")))
    assert phrases.matches(df, "i", words, many).count() == sum(map(len, found.values()))


def test_phrases_that_begin_alike_make_no_rows(spark):
    n = 400
    table = spark.createDataFrame([(f"p{i}", ["the", f"a{i}", "x"]) for i in range(n)] + [("one", ["the"]), ("nul", ["a\0\1b"]), ("two", ["a\0", "b"]), ("none", [])], "phrase string, words array<string>")
    texts = spark.createDataFrame([(k, ["the"] * 50 + [f"a{k}", "x"] + ["a\0", "b"] * (k == 7)) for k in range(n)] + [(-1, []), (-2, None)], "k long, w array<string>")
    found = phrases.matches(texts, "k", F.col("w"), table)
    got = {tuple(r) for r in found.collect()}
    assert got == {(k, f"p{k}") for k in range(n)} | {(k, "one") for k in range(n)} | {(7, "two")}
    # Rows that meet in the join are matches, repeats counted: nothing is left to compare.
    plan, joined = found._jdf.queryExecution().executedPlan(), []

    def walk(p):
        p = p.finalPhysicalPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if "QueryStage" in p.nodeName() else p
        if "Join" in p.nodeName():
            joined.append((p.metrics().apply("numOutputRows").value(), p.condition().isEmpty()))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    assert joined == [(n * 51 + 1, True)]
