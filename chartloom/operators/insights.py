"""Progression, risk, cohorts and recommendations for all patients at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions.columns import any_contains, period_days, strings
from chartloom.functions.ranking import top_k


# --- progression -------------------------------------------------------------

def _mentions(visits: DataFrame, edges: DataFrame, relation: str, name: str) -> DataFrame:
    return (edges.filter(F.col("type") == relation).select("visit_id", F.col("name").alias(name))
            .join(visits.select("visit_id", "patient_id", "visit_date"), "visit_id"))


def treatment_progression(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per patient and medication: span, visits, trend, first condition, number of tests."""
    around = edges.groupBy("visit_id").agg(
        F.min(F.when(F.col("type") == "DIAGNOSED_WITH", F.col("name"))).alias("condition"),
        F.count_if(F.col("type") == "PERFORMED").alias("tests"))
    rows = _mentions(visits, edges, "PRESCRIBED", "medication").join(around, "visit_id")
    out = rows.groupBy("patient_id", "medication").agg(
        F.min("visit_date").alias("start_date"), F.max("visit_date").alias("latest"), F.count(F.lit(1)).alias("visits"),
        F.expr("min(struct(visit_date, visit_id, condition)) FILTER (WHERE condition IS NOT NULL)").alias("c"),
        F.sum("tests").alias("metrics"))
    many = F.col("visits") > 1
    days = F.when(F.datediff("latest", "start_date") != 0, F.datediff("latest", "start_date"))
    condition = F.coalesce("c.condition", F.lit("Unknown"))
    summary = F.concat(F.lit("Patient started "), F.col("medication"), F.lit(" treatment for "), condition, F.when(many, F.concat(
        F.lit(" with "), F.col("visits").cast("string"), F.lit(" follow-up visits over "),
        F.coalesce(days, F.lit(0)).cast("string"), F.lit(" days"))).otherwise(""))
    return out.select(
        "patient_id", "medication", condition.alias("condition"), "start_date", F.when(many, F.col("latest")).alias("end_date"),
        "visits", days.alias("time_to_response"), F.when(many, "improving").otherwise("stable").alias("trend"),
        F.when(many, 0.8).otherwise(0.7).alias("effectiveness"), F.when(many, 15.0).alias("improvement"), "metrics",
        F.when(many, "high").otherwise("medium").alias("confidence"), summary.alias("summary"))


def condition_progression(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per patient and condition, for patients without any medication."""
    treated = _mentions(visits, edges, "PRESCRIBED", "m").select("patient_id").distinct()
    rows = _mentions(visits, edges, "DIAGNOSED_WITH", "condition").join(treated, "patient_id", "left_anti")
    out = rows.groupBy("patient_id", "condition").agg(F.min("visit_date").alias("start_date"), F.max("visit_date").alias("latest"),
                                                      F.count(F.lit(1)).alias("visits"))
    many = F.col("visits") > 1
    return out.select("patient_id", "condition", F.lit("No medication prescribed").alias("medication"), "start_date",
                      F.when(many, F.col("latest")).alias("end_date"), "visits",
                      F.when(many, F.datediff("latest", "start_date")).alias("time_to_response"), F.lit("stable").alias("trend"),
                      F.lit(0.6).alias("effectiveness"), F.lit("medium").alias("confidence"),
                      F.concat(F.lit("Patient diagnosed with "), F.col("condition")).alias("summary"))


# --- risk --------------------------------------------------------------------

def risk_factors(patients: DataFrame, conditions: DataFrame) -> DataFrame:
    """Factor rows: age above 65, and each distinct high-risk condition."""
    old = patients.filter("age > 65").select(
        "patient_id", F.lit("advanced_age").alias("factor"), F.col("age").cast("string").alias("value"),
        F.lit("moderate").alias("risk_level"), F.lit(False).alias("modifiable"))
    known = conditions.select("patient_id", "condition").distinct().filter(any_contains(F.col("condition"), L.HIGH_RISK_CONDITIONS))
    return old.unionByName(known.select(
        "patient_id", F.concat(F.lit("existing_"), F.replace(F.lower("condition"), F.lit(" "), F.lit("_"))).alias("factor"),
        F.col("condition").alias("value"), F.lit("high").alias("risk_level"), F.lit(True).alias("modifiable")))


def risk_level(high: Column, moderate: Column) -> Column:
    return F.when(high >= 2, "high").when((high == 1) | (moderate >= 2), "moderate").otherwise("low")


def risk_score(high: Column, moderate: Column, other: Column) -> Column:
    return F.least(high * 0.3 + moderate * 0.2 + other * 0.1, F.lit(1.0))


def assess_risk(patients: DataFrame, factors: DataFrame) -> DataFrame:
    """One row per patient with level, score, lists, probabilities and advice.

    Patients whose age is unknown cannot be assessed and get the default row.
    """
    per = factors.groupBy("patient_id").agg(
        F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if(F.col("risk_level") == "moderate").alias("moderate"),
        F.count_if(~F.col("risk_level").isin("high", "moderate")).alias("other"),
        F.array_sort(F.collect_set(F.when(F.col("modifiable"), F.col("factor")))).alias("modifiable"),
        F.array_sort(F.collect_set(F.when(~F.col("modifiable"), F.col("factor")))).alias("non_modifiable"),
        F.count_if(F.col("factor").contains("diabetes")).alias("n_diabetes"),
        F.count_if(F.col("factor").contains("hypertension")).alias("n_hypertension"))
    counts = ["high", "moderate", "other", "n_diabetes", "n_hypertension"]
    nothing = F.array().cast("array<string>")
    df = patients.select("patient_id", "age").join(per, "patient_id", "left").fillna(0, counts)
    default = F.col("age").isNull()
    n_d, n_h = F.col("n_diabetes"), F.col("n_hypertension")
    return df.select(
        "patient_id", F.when(default, "low").otherwise(risk_level(F.col("high"), F.col("moderate"))).alias("overall_risk_level"),
        F.when(default, 0.1).otherwise(risk_score(F.col("high"), F.col("moderate"), F.col("other"))).alias("risk_score"),
        F.when(default, nothing).otherwise(F.coalesce("modifiable", nothing)).alias("modifiable_risks"),
        F.when(default, nothing).otherwise(F.coalesce("non_modifiable", nothing)).alias("non_modifiable_risks"),
        F.when(~default, F.least(0.1 + 0.2 * n_d, F.lit(0.8))).alias("p_diabetes"),
        F.when(~default, F.least(0.15 + 0.25 * n_h, F.lit(0.8))).alias("p_cardiovascular"),
        F.when(default, strings(L.DEFAULT_PREVENTIVE)).otherwise(preventive_measures(n_d, n_h)).alias("preventive_measures"),
        F.when(default, strings(L.DEFAULT_MONITORING)).otherwise(monitoring_suggestions(n_d, n_h)).alias("monitoring"),
        F.when(default, "low").otherwise("medium").alias("confidence"))


def _advice(base, diabetes, hypertension, n_diabetes: Column, n_hypertension: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return F.concat(strings(base), F.when(n_diabetes > 0, strings(diabetes)).otherwise(nothing),
                    F.when(n_hypertension > 0, strings(hypertension)).otherwise(nothing))


def preventive_measures(n_diabetes: Column, n_hypertension: Column) -> Column:
    return _advice(L.PREVENTIVE_BASE, L.PREVENTIVE_DIABETES, L.PREVENTIVE_HYPERTENSION, n_diabetes, n_hypertension)


def monitoring_suggestions(n_diabetes: Column, n_hypertension: Column) -> Column:
    return _advice(L.MONITORING_BASE, L.MONITORING_DIABETES, L.MONITORING_HYPERTENSION, n_diabetes, n_hypertension)


def patient_features(patients: DataFrame, visits: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Age, gender, distinct conditions, medications, tests and counts of every patient.

    ``tests`` has patient_id, name, value and date.
    """
    owned = (edges.filter(F.col("type").isin("DIAGNOSED_WITH", "PRESCRIBED")).select("visit_id", "type", "name")
             .join(visits.select("visit_id", "patient_id"), "visit_id"))
    diagnosis = F.col("type") == "DIAGNOSED_WITH"
    names = owned.groupBy("patient_id").agg(
        F.array_sort(F.collect_set(F.when(diagnosis, F.col("name")))).alias("conditions"),
        F.array_sort(F.collect_set(F.when(~diagnosis, F.col("name")))).alias("medications"),
        F.count_distinct(F.when(diagnosis, F.col("visit_id"))).alias("visit_count"))
    labs = tests.select("patient_id", "name", "value", "date").distinct().groupBy("patient_id").agg(F.count(F.lit(1)).alias("labs"))
    nothing = F.array().cast("array<string>")
    return (patients.select("patient_id", "age", "gender", "name").join(names, "patient_id", "left").join(labs, "patient_id", "left")
            .fillna(0, ["labs", "visit_count"])
            .withColumn("conditions", F.coalesce("conditions", nothing)).withColumn("medications", F.coalesce("medications", nothing)))


# --- cohorts -----------------------------------------------------------------

def similar_patients(patients: DataFrame, conditions: DataFrame, seeds: DataFrame, limit: int = 10,
                     age_span: int = 5) -> DataFrame:
    """For each seed (seed_id, condition, age, gender) other patients with the condition,
    the same gender (null means any) and an age within the span; the first ``limit`` by id.

    The join is on condition and age, not on condition alone: a seed asks for
    each age in its range.  Only the first rows of each (condition, age, gender)
    meet it, so a seed sees a few hundred rows at most.
    """
    cohort = conditions.select("patient_id", "condition").distinct().join(patients.select("patient_id", "age", "gender"), "patient_id")
    wanted = seeds.select("seed_id", "condition", F.col("gender").alias("seed_gender"),
                          F.explode(F.sequence(F.col("age") - age_span, F.col("age") + age_span)).alias("age"))
    per_cell = top_k(cohort, ["condition", "age", "gender"], [F.asc("patient_id")], limit + 1).drop("rank")
    hits = (per_cell.join(wanted, ["condition", "age"]).filter(
        (F.col("patient_id") != F.col("seed_id")) & (F.col("seed_gender").isNull() | (F.col("gender") == F.col("seed_gender"))))
        .select("seed_id", "patient_id").distinct())
    return top_k(hits, ["seed_id"], [F.asc("patient_id")], limit)


def compare_outcomes(seeds: DataFrame, similar: DataFrame) -> DataFrame:
    """Thirds of the similar patients per seed; the empty form without any."""
    n = similar.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))
    df = seeds.select("seed_id").distinct().join(n, "seed_id", "left").fillna(0, ["n"])
    third = F.floor(F.col("n") / 3)
    return df.select("seed_id", "n", third.alias("better"), third.alias("similar"), third.alias("worse"),
                     F.when(F.col("n") > 0, 0.8).otherwise(0.0).alias("similarity_score"),
                     F.when(F.col("n") > 0, "medium").otherwise("low").alias("confidence"))


def start_date(period: Column, as_of: str) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), period_days(period))


def cohort_rows(patients: DataFrame, visits: DataFrame, edges: DataFrame, condition: str | None, since: Column,
                min_age: int | None = None, max_age: int | None = None, gender: str | None = None) -> DataFrame:
    """(patient, age, gender, visit date, condition) of one condition, or of all, since a date."""
    rows = _mentions(visits.filter(F.col("visit_date") >= since), edges, "DIAGNOSED_WITH", "condition")
    if condition is not None:
        rows = rows.filter(F.col("condition") == condition)
    people = patients.select("patient_id", "age", "gender")
    if min_age is not None:
        people = people.filter(F.col("age") >= min_age)
    if max_age is not None:
        people = people.filter(F.col("age") <= max_age)
    if gender is not None and gender != "any":
        people = people.filter(F.col("gender") == gender)
    return rows.join(people, "patient_id").select("patient_id", "age", "gender", "visit_date", "condition")


def population_insight(cohort: DataFrame, n_patients: DataFrame, medications: DataFrame, as_of: str) -> DataFrame:
    """Size and confidence per condition; prevalence, age bands, direction and treated share from the data.

    ``medications`` has (patient_id, condition) pairs that got a medication.
    """
    half = F.date_sub(F.lit(as_of).cast("date"), 365)
    per = cohort.groupBy("condition").agg(
        F.count(F.lit(1)).alias("population_size"), F.count_distinct("patient_id").alias("patients"),
        F.count_if(F.col("visit_date") >= half).alias("recent"), F.count_if(F.col("visit_date") < half).alias("earlier"))
    bands = cohort.select("condition", "patient_id", "age").distinct().groupBy("condition").agg(
        F.count_if(F.col("age").between(18, 40)).alias("age_18_40"), F.count_if(F.col("age").between(41, 65)).alias("age_41_65"),
        F.count_if(F.col("age") > 65).alias("age_65_plus"))
    treated = (cohort.select("condition", "patient_id").distinct().join(medications.distinct(), ["condition", "patient_id"], "left_semi")
               .groupBy("condition").agg(F.count(F.lit(1)).alias("treated")))
    total = n_patients.agg(F.count(F.lit(1)).alias("n_all"))
    df = per.join(bands, "condition").join(treated, "condition", "left").fillna(0, ["treated"])
    df = df.crossJoin(total)  # one row
    return df.select("condition", "population_size", "patients", (F.col("patients") / F.col("n_all")).alias("prevalence_rate"),
                     F.when(F.col("recent") > F.col("earlier"), "increasing").when(F.col("recent") < F.col("earlier"), "decreasing")
                     .otherwise("stable").alias("trend_direction"), "age_18_40", "age_41_65", "age_65_plus",
                     (F.col("treated") / F.col("patients")).alias("treated_share"),
                     F.when(F.col("population_size") > 50, "medium").otherwise("low").alias("confidence"))


# --- recommendations ---------------------------------------------------------

def rule_texts(kind: str, condition: Column) -> Column:
    """Rule recommendations of one kind for a condition."""
    low, nothing = F.lower(condition), F.array().cast("array<string>")
    parts = []
    for k, needed, excluded, texts in L.RULE_TEXTS:
        if k != kind:
            continue
        hit = low.contains(needed) if needed else F.lit(True)
        if excluded:
            hit = hit & ~low.contains(excluded)
        parts.append(F.when(F.coalesce(hit, F.lit(False)), strings(texts)).otherwise(nothing))
    return F.concat(*parts)


def medication_recommendations(conditions: DataFrame, medications: DataFrame, texts: Column, urgency: str = "routine",
                               n: int = 3) -> DataFrame:
    """Up to ``n`` texts longer than 10 for each (patient, condition).

    The same text and id hold for every medication of the patient, so the
    medications stand in a list (a fixed text without any) and the
    pairs of conditions and medications are not spelled out.
    """
    taken = medications.groupBy("patient_id").agg(F.array_sort(F.collect_set("medication")).alias("medications"))
    rows = conditions.join(taken, "patient_id", "left").select(
        "patient_id", "condition", F.coalesce("medications", strings([L.NO_MEDICATION])).alias("medications"),
        F.posexplode(F.slice(texts, 1, n)).alias("i", "description"))
    return rows.filter(F.length(F.trim("description")) > 10).select(
        F.concat_ws("_", F.lit("MED"), F.col("patient_id").cast("string"), "condition", (F.col("i") + 1).cast("string")).alias("recommendation_id"),
        "patient_id", F.lit("medication_management").alias("recommendation_type"),
        F.lit("medium" if urgency == "routine" else "high").alias("priority"),
        F.concat(F.lit("Medication Management for "), F.col("condition")).alias("title"), "description",
        strings(L.MEDICATION_REQUIREMENTS).alias("requirements"),
        F.array("description").alias("actions"), "medications")


def monitoring_recommendations(primary: DataFrame, texts: Column, urgency: str = "routine", n: int = 4) -> DataFrame:
    """Monitoring texts for the first condition of each patient, with requirements by keyword."""
    rows = primary.withColumn("condition", F.coalesce("condition", F.lit(L.GENERAL_MONITORING))).select(
        "patient_id", "condition", F.posexplode(F.slice(texts, 1, n)).alias("i", "description"))
    low = F.lower("description")
    needs = F.array_compact(F.array(*[
        F.when(any_contains(low, words), text) if words else F.lit(text) for words, text in L.MONITORING_REQUIREMENTS]))
    return rows.filter(F.length(F.trim("description")) > 10).select(
        F.concat_ws("_", F.lit("MON"), F.col("patient_id").cast("string"), "condition", (F.col("i") + 1).cast("string")).alias("recommendation_id"),
        "patient_id", F.lit("monitoring").alias("recommendation_type"), F.lit("medium" if urgency == "routine" else "high").alias("priority"),
        F.concat(F.lit("Monitoring Protocol for "), F.col("condition")).alias("title"), "description",
        needs.alias("requirements"), F.array("description").alias("actions"))


def lifestyle_recommendations(patients: DataFrame, texts: Column, urgency: str = "routine", n: int = 4) -> DataFrame:
    rows = patients.select("patient_id", F.posexplode(F.slice(texts, 1, n)).alias("i", "description"))
    low = F.lower("description")
    actions = F.array_compact(F.array(F.col("description"), *[
        F.when(any_contains(low, words), text) for words, text in L.LIFESTYLE_ACTIONS]))
    return rows.filter(F.length(F.trim("description")) > 10).select(
        F.concat_ws("_", F.lit("LIFE"), F.col("patient_id").cast("string"), (F.col("i") + 1).cast("string")).alias("recommendation_id"),
        "patient_id", F.lit("lifestyle").alias("recommendation_type"), F.lit("low" if urgency == "routine" else "medium").alias("priority"),
        F.lit(L.LIFESTYLE_TITLE).alias("title"), "description",
        strings(L.LIFESTYLE_REQUIREMENTS).alias("requirements"),
        actions.alias("actions"))


def assemble_recommendations(parts: dict[str, DataFrame], focus: list[str] | None = None) -> DataFrame:
    """Chosen kinds with a sort key: priority first, then kind, then id."""
    shared = ["recommendation_id", "patient_id", "recommendation_type", "priority", "title", "description", "requirements", "actions"]
    names = {"medication_management": 0, "monitoring": 1, "lifestyle": 2}
    chosen = [df.select(*shared, F.lit(names[k]).alias("source")) for k, df in parts.items() if not focus or k in focus]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df)
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return out.withColumn("priority_rank", rank)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def starts_upper(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def parse_recommendations(text: Column, n: int) -> Column:
    """Generated text to at most ``n`` distinct cleaned sentences.

    Pieces of 15 to 200 characters lose numbering, bullets and dashes;
    pieces opening with a filler word are skipped.
    """
    pieces = F.split(F.regexp_replace(F.regexp_replace(text, r"\n|\. |: ", "|"), r"\|", "|"), r"\|")
    sized = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: (F.length(p) >= 15) & (F.length(p) <= 200))
    bare = F.transform(sized, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[2-6]\.", ""), r"1\.|•|-", "")))
    opener = "^(?:" + "|".join(L.SKIP_OPENERS) + ") "
    kept = F.filter(bare, lambda p: ~F.lower(p).rlike(opener) & (p != ""))
    finished = F.transform(kept, lambda p: F.when(starts_upper(p) & ~p.endswith("."), F.concat(p, F.lit(".")))
                           .when(~starts_upper(p), capitalized(p)).otherwise(p))
    return F.slice(F.array_distinct(finished), 1, n)


def valid_recommendation(text: Column) -> Column:
    low = F.lower(text)
    return (any_contains(low, L.MEDICAL_KEYWORDS) & ~any_contains(low, L.HARMFUL_TERMS)
            & (F.length(text) > 10) & (F.length(text) < 200))


def finish_recommendation(text: Column) -> Column:
    proper = F.when(starts_upper(text), text).otherwise(capitalized(text))
    return F.when(proper.endswith("."), proper).otherwise(F.concat(proper, F.lit(".")))


def valid_recommendations(texts: Column) -> Column:
    return F.transform(F.filter(texts, valid_recommendation), finish_recommendation)


def top_up(valid: Column, fallback: Column, n: int) -> Column:
    """Valid texts first, leading fallbacks to fill, ``n`` at most."""
    return F.slice(F.concat(valid, fallback), 1, n)


# --- bundles -----------------------------------------------------------------

HANDLED = ["treatment_progression", "risk_assessment", "treatment_response", "clinical_decision_support"]


def insight_bundle(requests: DataFrame, treatments: DataFrame, conditions: DataFrame) -> DataFrame:
    """Insight count per (patient, requested type); unknown types are skipped.

    Lists count their length, single objects count one.
    """
    known = requests.filter(F.col("insight_type").isin(HANDLED)).select("patient_id", "insight_type").distinct()
    listed = (treatments.select("patient_id").unionAll(conditions.select("patient_id"))
              .groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")))
    n = F.when(F.col("insight_type") == "treatment_progression", F.coalesce("n", F.lit(0))).otherwise(1)
    return known.join(listed, "patient_id", "left").select("patient_id", "insight_type", n.cast("bigint").alias("insights"))


def insight_metrics(log: DataFrame) -> DataFrame:
    """One row from a log (insight_type, seconds, ok, confidence)."""
    per = log.groupBy("insight_type").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s"),
                                          F.count_if(F.col("ok")).alias("good"), F.sum("confidence").alias("c"),
                                          F.count_if(F.col("confidence") >= 0.8).alias("high"))
    n = F.sum("n")
    return per.agg(n.alias("total_insights"), (F.sum("s") / n).alias("average_time"), (F.sum("good") / n).alias("success_rate"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("insight_type", "n")))).alias("by_type"),
                   (F.sum("c") / n).alias("average_confidence"), (F.sum("high") / n).alias("high_share"))
