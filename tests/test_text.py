import math
import random
import re
from collections import Counter

import pytest
from conftest import day, dicts
from pyspark.sql import functions as F

from trackside.operators import textsearch
from trackside.operators.textsearch import ASCII_WORDS, Corpus, ImpactIndex, all_scores, english_stop_words, term_counts, tfidf, tfidf_match
from trackside.plans.gold import lap_features, train_regressor
from trackside.plans.hybrid import hybrid_search
from trackside import specs as S

DOCS = [
    (1, "a", "Green flag, track clear"),
    (2, "a", "Yellow flag in sector two"),
    (3, "a", "Car 44 pit entry; pit exit"),
    (4, "a", "Yellow flag in sector two"),
    (5, "b", "Green flag"),
    (6, "b", "the and of"),
    (7, "c", "Été à Montréal"),
]


def brute(texts):
    """{id: {term: weight}} and idf of one corpus."""
    stop = set(english_stop_words())
    words = {i: Counter(t for t in re.findall(r"\b\w\w+\b", s.lower()) if t not in stop) for i, s in texts.items()}
    df = Counter(t for c in words.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    out = {}
    for i, c in words.items():
        w = {t: n * idf[t] for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / length for t, x in w.items()}
    return out, idf


def test_weights(spark):
    got = tfidf(spark.createDataFrame(DOCS, "id long, g string, text string"), id="id", text="text", by=["g"]).collect()
    for group in "abc":
        expected, _ = brute({i: t for i, g, t in DOCS if g == group})
        found = {(r.id, r.term): r.weight for r in got if r.g == group}
        flat = {(i, t): w for i, ws in expected.items() for t, w in ws.items()}
        assert found.keys() == flat.keys()
        assert all(found[k] == pytest.approx(flat[k]) for k in flat)


def test_copies_count_like_repeated_documents(spark):
    whole = spark.createDataFrame(DOCS, "id long, g string, text string")
    packed = whole.groupBy("g", "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    a = {(r.id, r.term): r.weight for r in tfidf(whole, id="id", text="text", by=["g"]).collect()}
    b = {(r.id, r.term): r.weight for r in tfidf(packed, id="id", text="text", by=["g"], copies="n").collect()}
    assert all(b[k] == pytest.approx(a[k]) for k in b) and set(a) - set(b) == {k for k in a if k[0] == 4}


def ask(spark, questions, docs=DOCS, **options):
    q = spark.createDataFrame(questions, "q long, g string, question string")
    d = spark.createDataFrame(docs, "id long, g string, text string")
    found = tfidf_match(q, d, q_id="q", q_text="question", id="id", text="text", by=["g"], order=["id"], **options)
    return {r.q: (r.id, r.score, r.matched) for r in found.collect()}


def test_best_match(spark):
    got = ask(spark, [(1, "a", "green flag?"), (2, "a", "YELLOW flag"), (3, "a", "pit pit unknownword"), (4, "b", "flag")])
    weights, idf = brute({i: t for i, g, t in DOCS if g == "a"})

    def cosine(words, doc):
        v = {t: n * idf[t] for t, n in Counter(words).items() if t in idf}
        return sum(x * weights[doc].get(t, 0) for t, x in v.items()) / math.sqrt(sum(x * x for x in v.values()))

    assert got[1][0] == 1 and got[1][1] == pytest.approx(cosine(["green", "flag"], 1), abs=1e-9)
    assert got[2][0] == 2  # the same text as 4, which is later
    assert got[3][0] == 3 and got[3][1] == pytest.approx(cosine(["pit", "pit"], 3), abs=1e-9)
    assert got[4][0] == 5


def test_no_match(spark):
    got = ask(spark, [(1, "a", "rain or water"), (2, "a", "the of and"), (3, "zz", "flag"), (4, "c", "Montréal")])
    assert got[1] == (1, 0.0, False) and got[2] == (1, 0.0, False)
    assert got[3] == (None, None, False)
    assert got[4][0] == 7 and got[4][2]
    assert ask(spark, [(1, "a", "flag")], docs=[]) == {1: (None, None, False)}


def test_match_without_groups(spark):
    q = spark.createDataFrame([(1, "montréal"), (2, "nothing")], "q long, question string")
    d = spark.createDataFrame(DOCS, "id long, g string, text string").drop("g")
    found = tfidf_match(q, d, q_id="q", q_text="question", id="id", text="text", order=["id"])
    assert {r.q: (r.id, r.matched) for r in found.collect()} == {1: (7, True), 2: (1, False)}


def search(spark, views, questions, extra=()):
    messages = views["fact_race_control"]
    if extra:
        messages = messages.union(spark.createDataFrame(list(extra), S.RACE_CONTROL.schema))
    q = spark.createDataFrame(questions, "question_id long, session_key long, question string")
    found = hybrid_search(q, messages, views["dim_drivers"], views["fact_car_telemetry"])
    return {r["question_id"]: r for r in dicts(found)}


def test_hybrid_search(spark, views):
    rows = search(
        spark,
        views,
        [(1, 10014, "Green flag event"), (2, 10014, "Rain or water on track"), (3, 1, "Green flag"), (4, 10014, "sector two yellow")],
        extra=[(10014, None, "Flag", "YELLOW", "Yellow in sector two", day("11:59:50")), (10014, None, "Flag", "YELLOW", "Yellow in sector two", day("13:00:00"))],
    )
    hit = rows[1]
    assert hit["relevance"] > 0.05 and hit["message"] == "Green flag" and hit["driver_name"] == "Ana Costa (Amber Racing)"
    assert hit["avg_speed"] is None and "no telemetry" in hit["answer"]
    miss = rows[2]
    assert miss["relevance"] < 0.02 and miss["message"] is None and miss["answer"].startswith("No relevant message")
    assert rows[3]["answer"].startswith("No messages") and rows[3]["relevance"] == 0.0
    # No driver: all cars in the 15 s after the earliest of the equal messages.
    field = rows[4]
    assert field["date"] == "2025-03-16T11:59:50.000000" and field["driver_name"] == "N/A"
    assert field["avg_speed"] == round((307 + 311 + 318) / 3, 1) and field["min_speed"] == 307
    assert "all cars" in field["answer"]


def test_hybrid_telemetry_of_the_driver(spark, views):
    rows = search(spark, views, [(1, 10014, "engine problem")], extra=[(10014, 44, "Other", None, "Engine problem reported", day("12:00:00"))])
    assert (rows[1]["avg_speed"], rows[1]["max_rpm"], rows[1]["min_gear"]) == (309.0, 12000, 7)
    assert "average speed 309.0 km/h, top rpm 12000, lowest gear 7" in rows[1]["answer"]


def test_lap_features(spark, views):
    stints = spark.createDataFrame(
        [(10014, 44, 1, "soft", 1, 3, 2), (10014, 44, 2, "HARD", 4, None, 0), (10014, 1, 1, "WET", 1, 1, 0), (10014, 99, 1, "SOFT", 1, 2, 0)],
        S.STINTS.schema,
    )
    rows = {(r.driver_number, r.lap_number): r for r in lap_features(stints, views["fact_car_telemetry"]).collect()}
    assert len(rows) == 3 + 11 + 1  # the driver without telemetry is left out
    first = rows[44, 1]
    assert first.compound_num == 1.0 and first.tyre_age_at_start == 2 and first.throttle_intensity_pct == 100.0
    assert first.lap_duration_seconds == pytest.approx(92.0 + 0.0 + 2 * 0.12 + (330 - 311) * 0.05)
    assert rows[44, 5].lap_duration_seconds == pytest.approx(92.0 + 1.8 + 0.12 + 0.95)
    measured = spark.createDataFrame([(10014, 1, 1, 99.5)], "session_key long, driver_number long, lap_number long, lap_duration_seconds double")
    again = lap_features(stints, views["fact_car_telemetry"], measured).where("driver_number = 1").collect()
    assert [r.lap_duration_seconds for r in again] == [99.5]


def test_too_few_rows_to_train(spark, views):
    stints = spark.createDataFrame([(10014, 44, 1, "SOFT", 1, 4, 2)], S.STINTS.schema)
    assert train_regressor(lap_features(stints, views["fact_car_telemetry"])) is None


@pytest.mark.parametrize("pruned", [False, True])
def test_best_match_against_all_scores(spark, pruned):
    """Random texts with common and rare words, ties and copies."""
    rnd = random.Random(9)
    words = [f"w{n}" for n in range(60)]
    text = lambda n: " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=n))
    docs = [(i, "a" if i % 3 else "b", text(rnd.randint(1, 30))) for i in range(300)]
    docs += [(i, g, t) for i, (_, g, t) in zip(range(300, 330), docs)]
    questions = [(q, "ab"[q % 2], text(rnd.randint(1, 8))) for q in range(40)]
    got = ask(spark, questions, docs, stop_words=[], pruned=pruned)
    for q, group, asked in questions:
        weights, idf = brute({i: t for i, g, t in docs if g == group})
        v = {t: n * idf[t] for t, n in Counter(asked.split()).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        scores = {i: round(sum(x / length * w.get(t, 0) for t, x in v.items()), 12) for i, w in weights.items()}
        best = min(i for i in scores if scores[i] == max(scores.values()))
        assert got[q][0] == best and got[q][1] == pytest.approx(scores[best], abs=1e-9)


def test_few_postings_are_scored(spark):
    """Rows that reach the score's aggregates, against all (question, posting) pairs."""
    base = "/root/testdata/sf0.01"
    corpus = Corpus(spark.read.parquet(f"{base}/documents.parquet"), id="doc_id", text="text", token_pattern=ASCII_WORDS)
    asked = corpus.question_weights(spark.read.parquet(f"{base}/benchmark.parquet"), "item_id", "text")
    pairs = corpus.postings.join(asked, "term").count()
    index = ImpactIndex(corpus, asked, "item_id")
    scored = index.admitted(index.planned()).count()
    assert scored < pairs / 2


def test_texts_are_never_exchanged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = term_counts(docs, ["doc_id"], F.split("text", " "), ())
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Exchange" not in plan[plan.index("Generate") :]  # postings alone are exchanged
    rows = [("b a b", 1), ("", 2), (None, 3), ("c", 4)]
    found = term_counts(spark.createDataFrame(rows, "text string, id long"), ["id"], F.split("text", " "), ["c"])
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (1, "b", 2), (2, "", 1)]


def test_a_row_for_each_document(spark):
    """Words are counted inside the row; rows that repeat an id are one document."""
    rows = [(1, "b a b c"), (1, "a"), (2, ""), (3, None), (4, "the")]
    corpus = Corpus(spark.createDataFrame(rows, "id long, text string"), id="id", text="text", stop_words=["the"], token_pattern="[a-z]+")
    found = {r.id: [tuple(t) for t in r.terms] for r in corpus.rows.collect()}
    assert found == {1: [("a", 2), ("b", 2), ("c", 1)], 2: [], 3: [], 4: []}
    assert {r.term: r.idf for r in corpus.idf.collect()} == {t: pytest.approx(math.log(6 / 2) + 1) for t in "abc"}


@pytest.mark.parametrize("pruned", [False, True])
def test_common_terms_and_groups_of_questions(spark, monkeypatch, pruned):
    """Where few terms are looked up without an exchange, and questions come in several groups, the answers are the same."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choices([f"w{k}" for k in range(30)], weights=[1 / (k + 1) for k in range(30)], k=n))
    docs = [(i, "ab"[i % 2], text(12)) for i in range(60)]
    questions = [(q, "ab"[q % 2], text(4)) for q in range(12)]
    usual = ask(spark, questions, docs, stop_words=[], pruned=pruned)
    monkeypatch.setattr(textsearch, "COMMON", 9)
    monkeypatch.setattr(textsearch, "ASKED", 16)
    assert ask(spark, questions, docs, stop_words=[], pruned=pruned) == {q: (i, pytest.approx(s), m) for q, (i, s, m) in usual.items()}


def test_pairs_are_never_exchanged(spark):
    """Scores are added up where a document's postings are: nothing is exchanged by question."""
    docs, asked = "/root/testdata/sf0.001/documents.parquet", [(1, "the one"), (2, "that thing")]
    corpus = Corpus(spark.read.parquet(docs), id="doc_id", text="text", token_pattern=ASCII_WORDS)
    terms = corpus.question_weights(spark.createDataFrame(asked, "q long, text string"), "q", "text")
    plan = all_scores(corpus, textsearch.materialise(terms, "asked"), "q")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q#" not in plan and "hashpartitioning(doc_id#" in plan


def numbered_words(n):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    return [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(400)], k=20))) for i in range(n)]


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """Pairs of documents and questions are added up in as many partitions as hold ``TASK_PAIRS`` each, also where lengths are in fewer."""
    docs = spark.createDataFrame(numbered_words(400), "id long, text string")
    corpus = Corpus(docs, id="id", text="text", stop_words=[], token_pattern=ASCII_WORDS)
    questions = spark.createDataFrame([(q, t) for q, (_, t) in enumerate(numbered_words(12))], "q long, text string")
    asked = textsearch.materialise(corpus.question_weights(questions, "q", "text"), "asked")
    usual = {(r.q, r.id): r.score for r in all_scores(corpus, asked, "q").collect()}
    monkeypatch.setattr(textsearch, "TASK_PAIRS", 400)
    parts = corpus.pair_parts(asked, "q")
    assert parts == 12  # 400 documents and 12 questions, which have more postings in common
    found = all_scores(corpus, asked, "q").withColumn("task", F.spark_partition_id()).collect()
    held = Counter(r.task for r in found)
    assert len(held) == parts and max(held.values()) < 2 * 400
    assert {(r.q, r.id): r.score for r in found} == {k: pytest.approx(v) for k, v in usual.items()}
    assert corpus.pair_parts(asked.where("q < 0"), "q") == corpus.parts
    few = corpus.pair_parts(asked.where("term = 'w399' and q = 0"), "q")
    assert few == corpus.parts  # bounded by the postings that the terms meet


def test_a_task_sorts_no_more_with_more_documents(spark, monkeypatch):
    """Texts, rare postings and weights are dealt over partitions that follow their numbers; postings are exchanged as rows of documents."""
    docs = spark.createDataFrame(numbered_words(600), "id long, text string")
    options = {"id": "id", "text": "text", "stop_words": [], "token_pattern": ASCII_WORDS}
    usual = {(r.id, r.term): r.weight for r in tfidf(docs, **options).collect()}
    for name, value in (("TASK_ROWS", 1000), ("TASK_BYTES", 4000), ("COMMON", 20)):
        monkeypatch.setattr(textsearch, name, value)
    corpus = Corpus(docs, **options)
    assert len(corpus.rows.inputFiles()) > 5  # the session says 3 partitions
    assert corpus.parts == -(-len(usual) // 1000) > 3
    weights = corpus.weights()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", plan)) == {str(corpus.parts)}
    assert "Exchange" not in plan[plan.index("Window") : plan.index("Union")]
    found = weights.withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r.task for r in found).values()) < 2 * 1000
    assert {(r.id, r.term): r.weight for r in found} == {k: pytest.approx(v) for k, v in usual.items()}
