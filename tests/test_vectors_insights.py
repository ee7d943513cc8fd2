import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.operators import insights as I
from chartloom.operators import retrieval as H
from chartloom.operators import vector_index as VI
from chartloom.operators import vectors as V


def _plain(a, q, metric):
    if metric == "euclidean":
        d = ((a[:, None] - q[None]) ** 2).sum(2)
    else:
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v for v in (a, q))
        d = 1 - x @ y.T
    return d.round(9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "inner"])
@pytest.mark.parametrize("cell_rows", [VI.CELL_ROWS, 15])
def test_nearest_is_exact(spark, metric, cell_rows):
    rng = np.random.default_rng(1)
    a, q = rng.normal(size=(400, 8)).round(3), rng.normal(size=(23, 8)).round(3)
    a[50:60], a[70], a[80:200], q[3], q[4] = a[40:50], 0, a[300], 0, a[300]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(a)]
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (None, [1.0] * 8), (903, [None] * 8)]
    corpus = spark.createDataFrame(rows + odd, "id long, embedding array<float>").repartition(7)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(q)] + [("bad", None), ("short", [1.0])], "query_id string, embedding array<float>")
    got = {}
    for r in V.nearest(corpus, queries, 4, metric, pivots=9, cell_rows=cell_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    d = _plain(a.astype(np.float32).astype(float), q.astype(np.float32).astype(float), metric)
    assert set(got) == {f"q{i}" for i in range(len(q))}
    for i in range(len(q)):
        want = sorted(range(len(a)), key=lambda k: (d[k, i], k))[:4]
        assert [x for _, x in sorted(got[f"q{i}"])] == want


def test_index_compares_few_pairs_and_is_opened_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16)) * 5
    a = np.repeat(middle, 150, 0) + 0.2 * rng.normal(size=(3000, 16))
    corpus = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(a)], "id string, embedding array<double>")
    queries = spark.createDataFrame([(i, (middle[i % 20] + 0.2 * rng.normal(size=16)).tolist()) for i in range(60)], "query_id int, embedding array<double>")
    VI.build_index(corpus, "euclidean", str(tmp_path / "index"), pivots=60, cell_rows=100)
    index = VI.open_index(spark, str(tmp_path / "index"))
    compared = VI.visits(index, queries, 5).agg(F.sum("n")).first()[0]
    assert 60 * 5 <= compared < 0.2 * len(a) * 60
    assert VI.search(index, queries, 5).count() == 300
    # more rows asked for than there are: all of them
    assert VI.search(index, queries.limit(1), 4000).count() == 3000


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert not V.nearest(none, queries, 3).collect()


def test_cohesion(spark):
    v = np.random.default_rng(2).normal(size=(20, 5))
    df = spark.createDataFrame([(1, [float(x) for x in r]) for r in v], "k int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert V.group_cohesion(df, "k").first().cohesion == pytest.approx(float(np.mean(u @ u.T)))


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "id string, version int, body string")
    store = spark.createDataFrame([("a", 9, "old"), ("c", 1, "keep")], "id string, version int, body string")
    assert {r.id: r.body for r in V.upsert(store, rows).collect()} == {"a": "z", "b": "y", "c": "keep"}


def test_risk(spark):
    people = spark.createDataFrame([(1, 70), (2, 40), (3, None), (4, 66)], "patient_id int, age int")
    conditions = spark.createDataFrame([(1, "Type 2 Diabetes"), (2, "Hypertension"), (2, "Heart Disease"), (2, "diabetes")], "patient_id int, condition string")
    factors = I.risk_factors(people, conditions)
    assert ("existing_type_2_diabetes", "high") in {(r.factor, r.risk_level) for r in factors.collect()}
    got = {r.patient_id: r for r in I.assess_risk(people, factors).collect()}
    assert (got[1].overall_risk_level, round(got[1].risk_score, 6)) == ("moderate", 0.5)
    assert (round(got[1].p_diabetes, 6), round(got[1].p_cardiovascular, 6)) == (0.3, 0.15)
    assert got[2].overall_risk_level == "high" and got[4].overall_risk_level == "low" and got[4].risk_score == pytest.approx(0.2)
    assert (got[3].overall_risk_level, got[3].risk_score, got[3].confidence) == ("low", 0.1, "low")


def test_outcomes(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed_id int")
    similar = spark.createDataFrame([(1, i) for i in range(10)], "seed_id int, patient_id int")
    got = {r.seed_id: (r.better, r.similar, r.worse, r.confidence) for r in I.compare_outcomes(seeds, similar).collect()}
    assert got == {1: (3, 3, 3, "medium"), 2: (0, 0, 0, "low")}


def test_recommendation_texts(spark):
    text = "1. Monitor blood pressure every week\nthe rest is fine and long enough. check the lab - values: • Stop all medication right now today"
    got = spark.createDataFrame([(text,)], "t string").select(I.parse_recommendations(F.col("t"), 5).alias("p")).first().p
    assert got == ["Monitor blood pressure every week.", "Check the lab  values", "Stop all medication right now today."]
    ok = spark.createDataFrame([(got,)], "p array<string>").select(I.valid_recommendations(F.col("p")).alias("v")).first().v
    assert ok == ["Monitor blood pressure every week.", "Check the lab  values."]


@pytest.mark.parametrize("text,intent", [("compare drug A versus B", "treatment_comparison"), ("similar patients summary", "patient_summary"),
                                         ("what is new", "general_medical"), ("is there an interaction", "medication_interaction")])
def test_intents(spark, text, intent):
    assert spark.createDataFrame([(text,)], "q string").select(H.intent(F.col("q"))).first()[0] == intent


def test_answer_confidence(spark):
    ev = spark.createDataFrame([(1, 1.0), (1, .5)], "query_id int, relevance double")
    assert H.answer_confidence(ev).first().confidence == pytest.approx(0.77)


def test_generated_text_filters(spark):
    src = "one two three four five six"
    df = spark.createDataFrame([("short", src), ("word word word word word other", src), ("one two three four five six", src),
                                ("a fresh and different clinical sentence", src)], "t string, s string")
    assert [r[0] for r in df.select(H.low_quality(F.col("t"), F.col("s"))).collect()] == [True, True, True, False]
    assert spark.createDataFrame([("First part. tail",)], "t string").select(H.clean_generated(F.col("t"))).first()[0] == "First part."
