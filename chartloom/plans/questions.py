"""Question texts: each user turn of a conversation behind a clinical phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.plans.registry import table

PHRASES = [
    "Give me a summary of patient_1042", "Compare metformin  versus insulin for diabetes",
    "Which patients are similar with hypertension", "Is there an interaction of aspirin and lisinopril",
    "Show the progression over time of asthma", "What is new", "Population view of COPD, cancer, pneumonia and diabetes",
    "Patient x17: atorvastatin timeline",
]


def _sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
    return f"CASE (conv_id + turn) % {len(PHRASES)} {cases} END || '  ' || text"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "conversations").filter("role = 'user'")
            .select("conv_id", "turn", F.expr(_sql()).alias("query")))


SQL_QUESTIONS = f"questions AS (SELECT conv_id, turn, {_sql()} AS query FROM conversations WHERE role = 'user')"
