"""The phrase index gives for every rule what a search of the whole text gives."""

import random

import pytest
from pyspark.sql import functions as F

from govaudit.functions.text import asserted_occurrences, free_of_negators, no_negator_in, occurrences
from govaudit.operators import phrase_index
from govaudit.plans import packets

NEGATORS = ["no", "not", "never"]
WORDS = ["no", "not", "never,", "data", "database", "metadata", "raw", "log", "log.", "\"log\"", "Raw", "É", "é-x", "a\nb", "\t", "", "x.y*z", "(not)"]
PHRASES = ["data", "raw log", "log", "raw log data", "no raw", "atabase", "é", "x.y*z", "a\nb", "raw  log", " raw", "log ", "not data", "metadata raw log.", "xyz",
           "raw xyz log", "tabas", "\tlog", "RAW LOG", "b raw", "w l"]


def texts(n=60):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    return [*rows, (100, None), (101, ""), (102, "raw log"), (None, "raw log data"), (103, "data" * 40 + " raw" * 30), (104, " " * 80 + "no raw log")]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(f"R-{k}", p) for k, p in enumerate(PHRASES)], "rule_id string, phrase string")


def test_hits_equal_a_search_per_rule(spark, rules):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in texts()], "id long, text string, words string, _row int").repartition(4)
    got = {(r.id, r.rule_id): (r.n_found, r.n_asserted) for r in phrase_index.phrase_hits(rows, rules, ["id"], negators=NEGATORS).collect()}
    want = {}
    for k, phrase in enumerate(PHRASES):
        low = phrase.lower()
        found = rows.where("text IS NOT NULL").select("id", F.lower("text").alias("low")).select(
            "id", F.expr(occurrences("low", low)).alias("n"), F.expr(asserted_occurrences("low", low, NEGATORS)).alias("asserted"))
        want |= {(r.id, f"R-{k}"): (r.n, r.asserted) for r in found.collect() if r.n}
    assert got == want and len(got) > 300
    assert any(n > asserted for n, asserted in got.values())


def test_rules_that_cannot_be_searched(spark):
    rules = spark.createDataFrame([(1, ""), (2, "abab"), (3, "aa"), (4, None), (5, "ab"), (6, "x")], "rule_id int, phrase string")
    assert {r.rule_id for r in phrase_index.usable(rules).collect()} == {5, 6}


def test_equal_phrases_and_repeated_texts(spark):
    rows = spark.createDataFrame([(1, "raw log"), (1, "raw log"), (2, "no raw log")], "id long, text string")
    rules = spark.createDataFrame([("a", "raw log"), ("b", "Raw Log")], "rule_id string, phrase string")
    got = sorted(map(tuple, phrase_index.phrase_hits(rows, rules, ["id"], negators=NEGATORS).collect()))
    assert got == [(1, "a", 2, 2), (1, "b", 2, 2), (2, "a", 1, 0), (2, "b", 1, 0)]
    assert phrase_index.phrase_hits(rows.limit(0), rules, ["id"]).collect() == []
    assert phrase_index.phrase_hits(rows, rules.limit(0), ["id"]).collect() == []


def test_rarest_word_is_waited_for(spark):
    vocabulary = spark.createDataFrame([("the", 1000), ("rare", 2), ("other", 50)], "word string, n long")
    rules = spark.createDataFrame([("r", "the rare the"), ("s", "the the"), ("t", "the unknown the")], "rule_id string, phrase string")
    assert {(r.word, r.rule_id, r.k) for r in phrase_index.anchors(vocabulary, rules).collect()} == {("rare", "r", 1), ("the", "s", 0)}


def test_plan_reads_texts_once_and_has_no_python(spark, rules):
    rows = spark.createDataFrame([(i, t) for i, t in texts()], "id long, text string")
    plan = phrase_index.phrase_hits(rows, rules, ["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("lower(") == 0  # texts were cut into words when the index was written


def test_what_is_kept_does_not_multiply_rules_by_words(spark, monkeypatch):
    """All first words end in a letter that ends all words of the corpus."""
    corpus = [f"w{i}a" for i in range(300)]
    vocabulary = spark.createDataFrame([(w, 5) for w in corpus] + [(f"x{i}", 1) for i in range(40)], "word STRING, n BIGINT")
    rules = spark.createDataFrame([(f"r{i}", f"a x{i}") for i in range(40)], "rule_id STRING, phrase STRING")
    rows = []
    monkeypatch.setattr(phrase_index, "written", lambda df, name: rows.append(df.count()) or df)
    found = phrase_index.anchors(vocabulary, rules).collect()
    begun = {(f"r{i}", f"x{j}") for i in range(40) for j in range(40) if f"x{j}".startswith(f"x{i}")}
    assert {(r.rule_id, r.word) for r in found} == begun and {r.k for r in found} == {1}
    assert max(rows) <= 100


def made_by_joins(df):
    """The most rows that a join of the plan gave."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        return max([node.metrics().apply("numOutputRows").value() if "Join" in name else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_frequent_words_of_many_phrases(spark):
    """400 phrases share 40 words; the index's rows follow the occurrences, not places times phrases."""
    rng = random.Random(3)
    pairs = [f"alpha{i} beta{j}" for i in range(20) for j in range(20)]
    texts = [(k, " ".join(rng.choice(pairs) for _ in range(20))) for k in range(100)]
    rules = spark.createDataFrame([(p, p) for p in pairs], "rule_id string, phrase string")
    hits = phrase_index.phrase_hits(spark.createDataFrame(texts, "id long, text string"), rules, ["id"])
    assert hits.agg(F.sum("n_found")).first()[0] >= 2000  # a beginning such as 'beta1' is also one of 'beta10'
    assert made_by_joins(hits) < 8000


def test_a_phrase_of_many_texts_that_is_the_rule_of_many(spark, tmp_path):
    words = [f"w{k}{'abcdefg'[k % 7]}xyzq" for k in range(30)]
    spark.createDataFrame([(k, " ".join(words)) for k in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = packets.phrase_registry(spark, str(tmp_path))
    rows = found.collect()
    assert len(rows) > 300 and all((r.n_texts, r.n_found) == (60, 60) for r in rows)
    phrases = {" ".join(words[(d * 13 + j * 17) % 30:][: 1 + j % 3]) for d in range(60) for j in range(10)}
    assert made_by_joins(found) <= 60 * len(phrases)


def test_the_sieve_stops_most_and_loses_none(spark):
    keys = spark.range(3000).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 7 AS INT) AS b")
    through = phrase_index.sieve(keys, "a, b")
    assert phrase_index.sifted(keys, "a, b", through).count() == 3000
    assert phrase_index.sifted(spark.range(3000, 33000).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 7 AS INT) AS b"), "a, b", through).count() < 1500


def test_negators_by_one_expression(spark):
    rng = random.Random(5)
    pieces = ["no", "not", "never", "no,", "(not)", "know", "nono", "x", "é", " ", "  ", "\t", "\n", "\u00a0", "\u3000", ".", "'", "no.t", ""]
    rows = spark.createDataFrame([("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))),) for _ in range(3000)], "b string")
    for negators in (["no", "not", "never"], ["no.t", "é"], ["", "no"], ["<li><a", "x"]):
        got = rows.select(F.expr(no_negator_in("b", negators)).alias("x"), F.expr(free_of_negators("b", negators)).alias("y")).collect()
        assert all(r.x == r.y for r in got) and sum(r.x for r in got)
