"""Registered insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions.columns import string_map
from chartloom.operators import graph as G
from chartloom.operators import insights as I
from chartloom.plans import sqltext as X
from chartloom.plans import star
from chartloom.plans.registry import query, table
from chartloom.plans.star import AS_OF, SQL_GRAPH

# the risk rules look for clinical names, so part types stand for conditions
CONDITION_NAMES = {"ECONOMY": "Type 2 Diabetes", "SMALL": "Hypertension Stage 1", "LARGE": "Heart Disease",
                   "MEDIUM": "Asthma", "PROMO": "diabetes screening", "STANDARD": "Fracture"}
_NAMED = X.lookup("name", CONDITION_NAMES)


def _clinical(spark, sf):
    """Patients (age unknown below 500 of balance), visits, edges with clinical condition names."""
    p, v, e = star.patients(spark, sf), star.visits(spark, sf), star.edges(spark, sf)
    named = F.when(F.col("type") == "DIAGNOSED_WITH", F.element_at(string_map(CONDITION_NAMES), F.col("name"))).otherwise(F.col("name"))
    return p.withColumn("age", F.when(F.col("age") >= 5, F.col("age"))), v, e.withColumn("name", named)


_SQL_CLINICAL = f"""{SQL_GRAPH},
p AS (SELECT * REPLACE (CASE WHEN age >= 5 THEN age END AS age) FROM patients),
ce AS (SELECT visit_id, type, CASE WHEN type = 'DIAGNOSED_WITH' THEN {_NAMED} ELSE name END AS name FROM edges),
pc AS (SELECT DISTINCT patient_id, name AS condition FROM ce JOIN visits USING (visit_id) WHERE type = 'DIAGNOSED_WITH'),
pm AS (SELECT DISTINCT patient_id, name AS medication FROM ce JOIN visits USING (visit_id) WHERE type = 'PRESCRIBED')"""


def _conditions(v, e):
    return G.patient_entities(v, e.filter("type = 'DIAGNOSED_WITH'")).select("patient_id", F.col("name").alias("condition"))


def _days(df, *cols):
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else c for c in df.columns])


_SQL_I1 = """tp AS (SELECT m.patient_id, m.medication, min(m.visit_date) AS s, max(m.visit_date) AS e, count(*) AS visits,
  arg_min(c, row(m.visit_date, m.visit_id)) FILTER (c IS NOT NULL) AS condition, sum(t)::BIGINT AS metrics
  FROM (SELECT patient_id, visit_id, visit_date, name AS medication FROM ce JOIN visits USING (visit_id) WHERE type = 'PRESCRIBED') m
  JOIN (SELECT visit_id, min(name) FILTER (type = 'DIAGNOSED_WITH') AS c, count(*) FILTER (type = 'PERFORMED') AS t FROM ce GROUP BY visit_id) a USING (visit_id) GROUP BY ALL)"""


@query("i01_treatment_progression", f"""WITH {_SQL_CLINICAL}, {_SQL_I1}
SELECT patient_id, medication, coalesce(condition, 'Unknown') AS condition, s::VARCHAR AS start_date, CASE WHEN visits > 1 THEN e::VARCHAR END AS end_date, visits,
  CASE WHEN e <> s THEN (e - s)::INT END AS time_to_response, CASE WHEN visits > 1 THEN 'improving' ELSE 'stable' END AS trend, CASE WHEN visits > 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS effectiveness,
  CASE WHEN visits > 1 THEN 15.0 END::DOUBLE AS improvement, metrics, CASE WHEN visits > 1 THEN 'high' ELSE 'medium' END AS confidence,
  'Patient started ' || medication || ' treatment for ' || coalesce(condition, 'Unknown') || CASE WHEN visits > 1 THEN ' with ' || visits || ' follow-up visits over ' || (e - s) || ' days' ELSE '' END AS summary FROM tp""")
def i01(spark, sf):
    _, v, e = _clinical(spark, sf)
    return _days(I.treatment_progression(v, e), "start_date", "end_date")


@query("i02_condition_progression", f"""WITH {_SQL_CLINICAL}
SELECT patient_id, name AS condition, min(visit_date)::VARCHAR AS start_date, CASE WHEN count(*) > 1 THEN max(visit_date)::VARCHAR END AS end_date, count(*) AS visits,
  CASE WHEN count(*) > 1 THEN (max(visit_date) - min(visit_date))::INT END AS time_to_response, 'Patient diagnosed with ' || name AS summary
FROM ce JOIN visits USING (visit_id) WHERE type = 'DIAGNOSED_WITH' AND patient_id NOT IN (SELECT patient_id FROM visits JOIN ce USING (visit_id) WHERE type = 'PRESCRIBED') GROUP BY patient_id, name""")
def i02(spark, sf):
    _, v, e = _clinical(spark, sf)
    out = I.condition_progression(v, e)
    return _days(out, "start_date", "end_date").select("patient_id", "condition", "start_date", "end_date", "visits", "time_to_response", "summary")


_SQL_FACTORS = f"""f AS (SELECT patient_id, 'advanced_age' AS factor, age::VARCHAR AS value, 'moderate' AS risk_level, false AS modifiable FROM p WHERE age > 65
  UNION ALL SELECT patient_id, 'existing_' || replace(lower(condition), ' ', '_'), condition, 'high', true FROM pc WHERE {X.contains_any('condition', L.HIGH_RISK_CONDITIONS)}),
r AS (SELECT p.patient_id, age, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'moderate') AS moderate,
  coalesce(string_agg(factor, '|' ORDER BY factor) FILTER (modifiable), '') AS mods, coalesce(string_agg(factor, '|' ORDER BY factor) FILTER (NOT modifiable), '') AS non,
  count(*) FILTER (contains(factor, 'diabetes')) AS nd, count(*) FILTER (contains(factor, 'hypertension')) AS nh FROM p LEFT JOIN f USING (patient_id) GROUP BY p.patient_id, age)"""


def _factors(spark, sf):
    p, v, e = _clinical(spark, sf)
    return p, I.risk_factors(p, _conditions(v, e))


@query("i03_risk_factors", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT * FROM f")
def i03(spark, sf):
    return _factors(spark, sf)[1]


def _risk(name, columns_sql, columns):
    @query(name, f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, {columns_sql} FROM r")
    def run(spark, sf):
        out = I.assess_risk(*_factors(spark, sf))
        return out.select("patient_id", *columns)
    return run


_LEVEL = "CASE WHEN age IS NULL THEN 'low' WHEN high >= 2 THEN 'high' WHEN high = 1 OR moderate >= 2 THEN 'moderate' ELSE 'low' END"
_SCORE = "round(CASE WHEN age IS NULL THEN 0.1 ELSE least(high * 0.3 + moderate * 0.2, 1.0) END, 6)::DOUBLE"


def _sql_advice(default, base, d, h):
    return (f"CASE WHEN age IS NULL THEN '{'|'.join(default)}' ELSE '{'|'.join(base)}' || CASE WHEN nd > 0 THEN '|{'|'.join(d)}' ELSE '' END "
            f"|| CASE WHEN nh > 0 THEN '|{'|'.join(h)}' ELSE '' END END")


_risk("i04_risk_levels", f"{_LEVEL} AS overall_risk_level", ["overall_risk_level"])

@query("i05_risk_scores", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, {_SCORE} AS risk_score FROM r")
def i05(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).select("patient_id", F.round("risk_score", 6).alias("risk_score"))


@query("i06_modifiable_risks", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, CASE WHEN age IS NULL THEN '' ELSE mods END AS modifiable, CASE WHEN age IS NULL THEN '' ELSE non END AS non_modifiable FROM r")
def i06(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).select("patient_id", F.array_join("modifiable_risks", "|").alias("modifiable"),
                                                      F.array_join("non_modifiable_risks", "|").alias("non_modifiable"))


@query("i07_probabilities", f"""WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, CASE WHEN age IS NOT NULL THEN round(least(0.1 + 0.2 * nd, 0.8), 6) END::DOUBLE AS p_diabetes,
  CASE WHEN age IS NOT NULL THEN round(least(0.15 + 0.25 * nh, 0.8), 6) END::DOUBLE AS p_cardiovascular FROM r""")
def i07(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).select("patient_id", F.round("p_diabetes", 6).alias("p_diabetes"),
                                                      F.round("p_cardiovascular", 6).alias("p_cardiovascular"))


@query("i08_preventive_measures", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, "
       f"{_sql_advice(L.DEFAULT_PREVENTIVE, L.PREVENTIVE_BASE, L.PREVENTIVE_DIABETES, L.PREVENTIVE_HYPERTENSION)} AS measures FROM r")
def i08(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).select("patient_id", F.array_join("preventive_measures", "|").alias("measures"))


@query("i09_monitoring", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, "
       f"{_sql_advice(L.DEFAULT_MONITORING, L.MONITORING_BASE, L.MONITORING_DIABETES, L.MONITORING_HYPERTENSION)} AS monitoring FROM r")
def i09(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).select("patient_id", F.array_join("monitoring", "|").alias("monitoring"))


@query("i10_risk_confidence", f"WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT CASE WHEN age IS NULL THEN 'low' ELSE 'medium' END AS confidence, {_LEVEL} AS overall_risk_level, count(*) AS patients FROM r GROUP BY ALL")
def i10(spark, sf):
    return I.assess_risk(*_factors(spark, sf)).groupBy("confidence", "overall_risk_level").agg(F.count(F.lit(1)).alias("patients"))


@query("i11_patient_features", f"""WITH {_SQL_CLINICAL}
SELECT p.patient_id, age, gender, name, coalesce((SELECT string_agg(condition, '|' ORDER BY condition) FROM pc WHERE pc.patient_id = p.patient_id), '') AS conditions,
  coalesce((SELECT string_agg(medication, '|' ORDER BY medication) FROM pm WHERE pm.patient_id = p.patient_id), '') AS medications,
  (SELECT count(DISTINCT (r.name, r.quantity, visit_date)) FROM raw_edges r JOIN visits USING (visit_id) WHERE type = 'PERFORMED' AND visits.patient_id = p.patient_id) AS labs,
  (SELECT count(DISTINCT visit_id) FROM ce JOIN visits USING (visit_id) WHERE type = 'DIAGNOSED_WITH' AND visits.patient_id = p.patient_id) AS visit_count FROM p""")
def i11(spark, sf):
    p, v, e = _clinical(spark, sf)
    tests = (star.raw_edges(spark, sf).filter("type = 'PERFORMED'").join(v, "visit_id")
             .select("patient_id", "name", F.col("quantity").alias("value"), F.col("visit_date").alias("date")))
    out = I.patient_features(p, v, e, tests)
    return out.select("patient_id", "age", "gender", "name", F.array_join("conditions", "|").alias("conditions"),
                      F.array_join("medications", "|").alias("medications"), "labs", "visit_count")


_SQL_SIMILAR = """seeds AS (SELECT p.patient_id AS seed_id, min(condition) AS condition, any_value(age) AS age, CASE WHEN any_value(gender) <> 'MACHINERY' THEN any_value(gender) END AS gender
  FROM p JOIN pc USING (patient_id) WHERE age IS NOT NULL GROUP BY p.patient_id),
sim AS (SELECT * FROM (SELECT seed_id, patient_id, row_number() OVER (PARTITION BY seed_id ORDER BY patient_id) AS rank FROM (
  SELECT DISTINCT seed_id, p.patient_id FROM seeds s JOIN pc ON pc.condition = s.condition JOIN p ON p.patient_id = pc.patient_id
  WHERE p.patient_id <> seed_id AND abs(p.age - s.age) <= 5 AND (s.gender IS NULL OR s.gender = p.gender))) WHERE rank <= 10)"""


def _similar(spark, sf):
    p, v, e = _clinical(spark, sf)
    c = _conditions(v, e)
    first = c.groupBy("patient_id").agg(F.min("condition").alias("condition"))
    seeds = p.filter("age IS NOT NULL").join(first, "patient_id").select(
        F.col("patient_id").alias("seed_id"), "condition", "age", F.when(F.col("gender") != "MACHINERY", F.col("gender")).alias("gender"))
    return seeds, I.similar_patients(p.filter("age IS NOT NULL"), c, seeds)


@query("i12_similar_patients", f"WITH {_SQL_CLINICAL}, {_SQL_SIMILAR} SELECT seed_id, patient_id, rank::INT AS rank FROM sim")
def i12(spark, sf):
    return _similar(spark, sf)[1]


@query("i13_outcome_comparison", f"""WITH {_SQL_CLINICAL}, {_SQL_SIMILAR} SELECT seed_id, count(patient_id) AS n, count(patient_id) // 3 AS better, count(patient_id) // 3 AS similar, count(patient_id) // 3 AS worse,
  CASE WHEN count(patient_id) > 0 THEN 0.8 ELSE 0 END::DOUBLE AS similarity_score, CASE WHEN count(patient_id) > 0 THEN 'medium' ELSE 'low' END AS confidence
FROM seeds LEFT JOIN sim USING (seed_id) GROUP BY seed_id""")
def i13(spark, sf):
    return I.compare_outcomes(*_similar(spark, sf)).select("seed_id", "n", "better", "similar", "worse", "similarity_score", "confidence")


@query("i14_cohort_rows", f"""WITH {_SQL_CLINICAL} SELECT patient_id, age, gender, visit_date::VARCHAR AS visit_date, ce.name AS condition FROM ce JOIN visits USING (visit_id) JOIN p USING (patient_id)
WHERE type = 'DIAGNOSED_WITH' AND ce.name = 'Type 2 Diabetes' AND visit_date >= DATE '{AS_OF}' - 1095 AND age BETWEEN 30 AND 70""")
def i14(spark, sf):
    p, v, e = _clinical(spark, sf)
    rows = I.cohort_rows(p, v, e, "Type 2 Diabetes", I.start_date(F.lit("3 years"), AS_OF), 30, 70, "any")
    return _days(rows, "visit_date")


_PERIODS = ["2 years", "6 months", "90 days", "last year", "some months", "forever"]


@query("i15_periods", f"""WITH t AS (SELECT event_id, CASE event_id % 6 {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PERIODS))} END AS period FROM events)
SELECT event_id, period, (DATE '{AS_OF}' - CASE period WHEN '2 years' THEN 730 WHEN '6 months' THEN 180 WHEN '90 days' THEN 90 WHEN 'last year' THEN 365 WHEN 'some months' THEN 180 ELSE 365 END)::DATE::VARCHAR AS start_date FROM t""")
def i15(spark, sf):
    period = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PERIODS)) + " END"
    rows = table(spark, sf, "events").select("event_id", F.expr(period).alias("period"))
    return rows.withColumn("start_date", I.start_date(F.col("period"), AS_OF).cast("string"))


@query("i16_population", f"""WITH {_SQL_CLINICAL}, c AS (SELECT p.patient_id, age, visit_date, visit_id, ce.name AS condition FROM ce JOIN visits USING (visit_id) JOIN p USING (patient_id)
  WHERE type = 'DIAGNOSED_WITH' AND visit_date >= DATE '{AS_OF}' - 730),
t AS (SELECT DISTINCT c.patient_id, condition FROM c JOIN ce ON ce.visit_id = c.visit_id AND ce.type = 'PRESCRIBED')
SELECT condition, count(*) AS population_size, count(DISTINCT patient_id) AS patients, round(count(DISTINCT patient_id) / (SELECT count(*) FROM p)::DOUBLE, 6) AS prevalence_rate,
  CASE WHEN count(*) FILTER (visit_date >= DATE '{AS_OF}' - 365) > count(*) FILTER (visit_date < DATE '{AS_OF}' - 365) THEN 'increasing' WHEN count(*) FILTER (visit_date >= DATE '{AS_OF}' - 365) < count(*) FILTER (visit_date < DATE '{AS_OF}' - 365) THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  count(DISTINCT patient_id) FILTER (age BETWEEN 18 AND 40) AS age_18_40, count(DISTINCT patient_id) FILTER (age BETWEEN 41 AND 65) AS age_41_65,
  count(DISTINCT patient_id) FILTER (age > 65) AS age_65_plus, round((SELECT count(*) FROM t WHERE t.condition = c.condition) / count(DISTINCT patient_id)::DOUBLE, 6) AS treated_share,
  CASE WHEN count(*) > 50 THEN 'medium' ELSE 'low' END AS confidence FROM c GROUP BY condition""")
def i16(spark, sf):
    p, v, e = _clinical(spark, sf)
    since = I.start_date(F.lit("2 years"), AS_OF)
    cohort = I.cohort_rows(p, v, e, None, since)
    recent = v.filter(F.col("visit_date") >= since).select("visit_id", "patient_id")
    both = (e.filter("type = 'DIAGNOSED_WITH'").select("visit_id", F.col("name").alias("condition")).join(recent, "visit_id")
            .join(e.filter("type = 'PRESCRIBED'").select("visit_id"), "visit_id", "left_semi").select("patient_id", "condition"))
    out = I.population_insight(cohort, p, both, AS_OF)
    return out.select("condition", "population_size", "patients", F.round("prevalence_rate", 6).alias("prevalence_rate"), "trend_direction",
                      "age_18_40", "age_41_65", "age_65_plus", F.round("treated_share", 6).alias("treated_share"), "confidence")


# --- recommendations ---------------------------------------------------------

def _sql_rules(kind, condition, n):
    low = f"lower({condition})"
    parts = []
    for k, need, excl, texts in L.RULE_TEXTS:
        if k == kind:
            arr = "[" + ", ".join(X.q(t) for t in texts) + "]"
            test = " AND ".join([f"contains({low}, '{need}')"] * bool(need) + [f"NOT contains({low}, '{excl}')"] * bool(excl)) or "true"
            parts.append(f"CASE WHEN {test} THEN {arr} ELSE []::VARCHAR[] END")
    return f"list_concat({', '.join(parts)})[1:{n}]"


@query("i17_medication_recommendations", f"""WITH {_SQL_CLINICAL}, m AS (SELECT patient_id, string_agg(medication, '|' ORDER BY medication) AS meds FROM pm GROUP BY patient_id),
x AS (SELECT pc.patient_id, condition, coalesce(meds, 'No current medication') AS medications, unnest({_sql_rules('treatment', 'condition', 3)}) AS description, unnest(range(3)) AS i FROM pc LEFT JOIN m USING (patient_id))
SELECT 'MED_' || patient_id || '_' || condition || '_' || (i + 1) AS recommendation_id, 'medium' AS priority, description, medications FROM x WHERE length(description) > 10""")
def i17(spark, sf):
    p, v, e = _clinical(spark, sf)
    meds = G.patient_entities(v, e.filter("type = 'PRESCRIBED'")).select("patient_id", F.col("name").alias("medication"))
    out = I.medication_recommendations(_conditions(v, e), meds, I.rule_texts("treatment", F.col("condition")))
    return out.select("recommendation_id", "priority", "description", F.array_join("medications", "|").alias("medications"))


def _primary(spark, sf):
    p, v, e = _clinical(spark, sf)
    first = _conditions(v, e).groupBy("patient_id").agg(F.min("condition").alias("condition"))
    return p.select("patient_id").join(first, "patient_id", "left")


_SQL_MON = f"""mon AS (SELECT patient_id, condition, unnest({_sql_rules('monitoring', 'condition', 4)}) AS description, unnest(range(4)) AS i
  FROM (SELECT p.patient_id, coalesce(min(condition), 'General Health Monitoring') AS condition FROM p LEFT JOIN pc USING (patient_id) GROUP BY p.patient_id))"""


@query("i18_monitoring_recommendations", f"""WITH {_SQL_CLINICAL}, {_SQL_MON}
SELECT 'MON_' || patient_id || '_' || condition || '_' || (i + 1) AS recommendation_id, description,
  concat_ws('|', 'Regular follow-up assessments', CASE WHEN {X.contains_any('lower(description)', ['blood', 'lab'])} THEN 'Laboratory monitoring' END,
    CASE WHEN {X.contains_any('lower(description)', ['appointment', 'visit'])} THEN 'Scheduled clinical visits' END, CASE WHEN contains(lower(description), 'vital') THEN 'Vital signs monitoring' END) AS requirements FROM mon""")
def i18(spark, sf):
    primary = _primary(spark, sf)
    texts = I.rule_texts("monitoring", F.coalesce("condition", F.lit("General Health Monitoring")))
    out = I.monitoring_recommendations(primary.withColumn("condition", F.coalesce("condition", F.lit("General Health Monitoring"))), texts)
    return out.select("recommendation_id", "description", F.array_join("requirements", "|").alias("requirements"))


_SQL_LIFE = f"""life AS (SELECT c_custkey AS patient_id, unnest({_sql_rules('preventive', "'diabetes'", 7)}[1:4]) AS description, unnest(range(4)) AS i FROM customer)"""


@query("i19_lifestyle_recommendations", f"""WITH {_SQL_LIFE} SELECT 'LIFE_' || patient_id || '_' || (i + 1) AS recommendation_id, 'low' AS priority,
  concat_ws('|', description, CASE WHEN {X.contains_any('lower(description)', ['exercise', 'activity'])} THEN 'Consult with healthcare provider before starting new exercise program' END,
  CASE WHEN {X.contains_any('lower(description)', ['diet', 'nutrition'])} THEN 'Consider consultation with registered dietitian' END) AS actions FROM life""")
def i19(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"))
    out = I.lifestyle_recommendations(p, I.rule_texts("preventive", F.lit("diabetes")))
    return out.select("recommendation_id", "priority", F.array_join("actions", "|").alias("actions"))


@query("i20_assembled_recommendations", f"""WITH {_SQL_CLINICAL}, {_SQL_MON}, {_SQL_LIFE},
mm AS (SELECT patient_id, string_agg(medication, '|' ORDER BY medication) AS meds FROM pm GROUP BY patient_id),
mx AS (SELECT patient_id, condition, unnest({_sql_rules('treatment', 'condition', 3)}) AS description, unnest(range(3)) AS i FROM pc),
u AS (SELECT patient_id, 'MED_' || patient_id || '_' || condition || '_' || (i + 1) AS id, description, 0 AS source, 2 AS priority_rank FROM mx WHERE length(description) > 10
  UNION ALL SELECT patient_id, 'MON_' || patient_id || '_' || condition || '_' || (i + 1), description, 1, 2 FROM mon UNION ALL SELECT patient_id, 'LIFE_' || patient_id || '_' || (i + 1), description, 2, 1 FROM life)
SELECT patient_id, id AS recommendation_id, description, row_number() OVER (PARTITION BY patient_id ORDER BY priority_rank DESC, source, id)::INT AS position FROM u""")
def i20(spark, sf):
    from pyspark.sql import Window
    primary = _primary(spark, sf).withColumn("condition", F.coalesce("condition", F.lit("General Health Monitoring")))
    _, v, e = _clinical(spark, sf)
    meds = G.patient_entities(v, e.filter("type = 'PRESCRIBED'")).select("patient_id", F.col("name").alias("medication"))
    parts = {"medication_management": I.medication_recommendations(_conditions(v, e), meds, I.rule_texts("treatment", F.col("condition"))),
             "monitoring": I.monitoring_recommendations(primary, I.rule_texts("monitoring", F.col("condition"))),
             "lifestyle": I.lifestyle_recommendations(primary.select("patient_id"), I.rule_texts("preventive", F.lit("diabetes")))}
    out = I.assemble_recommendations(parts)
    w = Window.partitionBy("patient_id").orderBy(F.desc("priority_rank"), "source", "recommendation_id")
    return out.select("patient_id", "recommendation_id", "description", F.row_number().over(w).alias("position"))


_SQL_PARSE = f"""pieces AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(replace(replace(text, chr(10), '|'), '. ', '|'), ': ', '|'), '|'), lambda p: trim(p)), lambda p: length(p) BETWEEN 15 AND 200) AS a FROM conversations),
bare AS (SELECT conv_id, turn, list_filter(list_transform(a, lambda p: trim(regexp_replace(regexp_replace(p, '[2-6]\\.', '', 'g'), '1\\.|•|-', '', 'g'))),
  lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:{'|'.join(L.SKIP_OPENERS)}) ')) AS b FROM pieces),
done AS (SELECT conv_id, turn, list_transform(b, lambda p: CASE WHEN regexp_matches(p, '^\\p{{Lu}}') THEN CASE WHEN ends_with(p, '.') THEN p ELSE p || '.' END ELSE upper(left(p, 1)) || lower(substr(p, 2)) END) AS d FROM bare),
uniq AS (SELECT conv_id, turn, list_filter(d, lambda x, i: list_position(d, x) = i)[1:4] AS u FROM done)"""


@query("i21_parsed_recommendations", f"WITH {_SQL_PARSE} SELECT conv_id, turn, coalesce(array_to_string(u, '|'), '') AS recommendations FROM uniq")
def i21(spark, sf):
    parsed = I.parse_recommendations(F.col("text"), 4)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(parsed, "|").alias("recommendations"))


_SQL_VALID = (f"{X.contains_any('lower(s)', L.MEDICAL_KEYWORDS)} AND NOT {X.contains_any('lower(s)', L.HARMFUL_TERMS)} AND length(s) > 10 AND length(s) < 200")


@query("i22_valid_recommendations", f"""WITH t AS (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, count(*) FILTER ({_SQL_VALID}) AS valid FROM t GROUP BY doc_id""")
def i22(spark, sf):
    sentences = table(spark, sf, "documents").select("doc_id", F.split("text", r"\.").alias("s"))
    return sentences.select("doc_id", F.size("s").cast("bigint").alias("sentences"),
                            F.size(I.valid_recommendations(F.col("s"))).cast("bigint").alias("valid"))


@query("i23_rule_texts", f"""WITH c AS (SELECT p_partkey AS id, {X.lookup('p_type', CONDITION_NAMES)} AS condition FROM part)
SELECT id, condition, array_to_string({_sql_rules('treatment', 'condition', 20)}, '|') AS treatment, array_to_string({_sql_rules('monitoring', 'condition', 20)}, '|') AS monitoring,
  array_to_string({_sql_rules('preventive', 'condition', 20)}, '|') AS preventive FROM c""")
def i23(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(string_map(CONDITION_NAMES), F.col("p_type")).alias("condition"))
    return c.select("id", "condition", *[F.array_join(I.rule_texts(k, F.col("condition")), "|").alias(k) for k in ("treatment", "monitoring", "preventive")])


@query("i24_topped_up", f"""WITH {_SQL_PARSE}, v AS (SELECT conv_id, turn, list_filter(u, lambda s: {_SQL_VALID}) AS ok FROM uniq)
SELECT conv_id, turn, array_to_string(list_concat(ok, {_sql_rules('treatment', "'hypertension'", 20)})[1:5], '|') AS recommendations FROM v""")
def i24(spark, sf):
    valid = I.valid_recommendations(I.parse_recommendations(F.col("text"), 4))
    out = I.top_up(valid, I.rule_texts("treatment", F.lit("hypertension")), 5)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(out, "|").alias("recommendations"))


@query("i25_requested_patients", f"""WITH {_SQL_CLINICAL}, {_SQL_FACTORS} SELECT patient_id, {_LEVEL} AS overall_risk_level FROM r WHERE patient_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def i25(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("patient_id")).distinct()
    p, f = _factors(spark, sf)
    return I.assess_risk(p.join(ids, "patient_id", "left_semi"), f.join(ids, "patient_id", "left_semi")).select("patient_id", "overall_risk_level")


@query("i26_insight_metrics", """WITH l AS (SELECT event_type AS insight_type, value AS seconds, user_id % 10 <> 0 AS ok, CASE WHEN value > 50 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM events)
SELECT count(*) AS total_insights, round(avg(seconds), 6) AS average_time, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS success_rate,
  (SELECT string_agg(insight_type || '=' || n, '|' ORDER BY insight_type) FROM (SELECT insight_type, count(*) AS n FROM l GROUP BY 1)) AS by_type,
  round(avg(confidence), 6) AS average_confidence, round(count(*) FILTER (confidence >= 0.8) / count(*)::DOUBLE, 6) AS high_share FROM l""")
def i26(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("insight_type"), F.col("value").alias("seconds"), (F.col("user_id") % 10 != 0).alias("ok"),
                                            F.when(F.col("value") > 50, 0.9).otherwise(0.6).alias("confidence"))
    m = I.insight_metrics(log)
    shown = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("total_insights", *[F.round(c, 6).alias(c) for c in ("average_time", "success_rate", "average_confidence", "high_share")],
                    F.array_join(shown, "|").alias("by_type"))


@query("i27_insight_bundle", f"""WITH {_SQL_CLINICAL}, rq AS (SELECT DISTINCT o_custkey AS patient_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'treatment_progression' WHEN '2-HIGH' THEN 'risk_assessment' WHEN '3-MEDIUM' THEN 'clinical_decision_support' ELSE 'comparative' END AS insight_type FROM orders)
SELECT patient_id, insight_type, CASE WHEN insight_type = 'treatment_progression' THEN (SELECT count(*) FROM pm WHERE pm.patient_id = rq.patient_id)
  + CASE WHEN rq.patient_id IN (SELECT patient_id FROM pm) THEN 0 ELSE (SELECT count(*) FROM pc WHERE pc.patient_id = rq.patient_id) END ELSE 1 END AS insights FROM rq WHERE insight_type <> 'comparative'""")
def i27(spark, sf):
    kinds = string_map({"1-URGENT": "treatment_progression", "2-HIGH": "risk_assessment", "3-MEDIUM": "clinical_decision_support"})
    req = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"),
                                            F.coalesce(F.element_at(kinds, F.col("o_orderpriority")), F.lit("comparative")).alias("insight_type"))
    _, v, e = _clinical(spark, sf)
    return I.insight_bundle(req, I.treatment_progression(v, e), I.condition_progression(v, e))
