"""Clinical notes rendered from orders, the same text in Spark and in the check SQL.

Each order becomes one ASCII note with three dated sections, vitals, labs, a
diagnosis and prescriptions, picked by its keys.  Some notes are short or carry
no date.  The rendering is one projection over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.spans import dealt
from chartloom.plans.registry import table

SYMPTOMS = ["fatigue", "chest pain", "headache", "nausea", "shortness of breath", "dizziness", "fever"]
CONDITIONS = ["hypertension", "Type 2 Diabetes Mellitus", "asthma", "hyperlipidemia", "pneumonia",
              "chronic kidney disease", "depression", "obesity"]
DRUGS = ["metformin", "lisinopril", "atorvastatin", "insulin", "aspirin", "amoxicillin"]
FREQUENCIES = ["daily", "BID", "twice daily", "every 8 hours"]
PROCEDURES = ["chest X-ray", "ECG", "blood test", "MRI", "colonoscopy", "CT scan"]
PLACES = ["City Clinic", "General Hospital", "Quest Laboratory"]


def _pick(expr: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {cases} END"


def _num(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def note_sql(spark: bool) -> str:
    """The note of one order as an SQL expression of either dialect."""
    k, c = "o_orderkey", "o_custkey"

    def day(offset: int, java: str, c_style: str) -> str:
        at = f"(o_orderdate + INTERVAL '{offset}' DAY)"
        return f"date_format({at}, '{java}')" if spark else f"strftime({at}, '{c_style}')"

    newline = "'\\n'" if spark else "chr(10)"
    first = ["'Visit on '", day(0, "MM/dd/yyyy", "%m/%d/%Y"), "'. Patient reports '", _pick(k, SYMPTOMS), "' and '",
             _pick(c, SYMPTOMS), "'. BP: '", _num(f"{k} % 80 + 100"), "'/'", _num(f"{c} % 40 + 60"), "' mmHg, HR: '",
             _num(f"{k} % 50 + 60"), "' bpm. HbA1c: '", _num(f"{k} % 6 + 5"), "'.'", _num(f"{c} % 10"),
             "'%. Diagnosed with '", _pick(c, CONDITIONS), "'. Prescribed '", _pick(k, DRUGS), "' '",
             _num(f"({k} % 8 + 1) * 50"), "' mg '", _pick(f"({k} + {c})", FREQUENCIES), "'.'"]
    second = ["'Follow-up visit '", day(14, "yyyy-MM-dd", "%Y-%m-%d"), "': '", _pick(k, PROCEDURES),
              "' performed at '", _pick(c, PLACES), "'. Hemoglobin: '", _num(f"{k} % 6 + 10"), "'.'", _num(f"{k} % 10"),
              "' g/dL range 12.0-16.0. WBC '", _num(f"{k} % 7 + 4"), "'.'", _num(f"{c} % 10"),
              "'. Assessment: stable. Plan: repeat lab work in '", _num(f"{k} % 11 + 1"), "' months.'"]
    third = ["'Seen on '", day(60, "MMMM d, yyyy", "%B %-d, %Y"), "' by Dr. Smith for '", _pick(f"({k} + 3)", CONDITIONS),
             "'. Severe back pain for '", _num(f"{c} % 20 + 2"), "' days. Procedure: '", _pick(c, PROCEDURES),
             "'. Continue '", _pick(c, DRUGS), "' '", _num(f"({c} % 4 + 1) * 10"), "' mg. Priority '", "o_orderpriority",
             "'.'"]
    full = " || ".join([*first, newline, newline, *second, newline, newline, *third])
    undated = " || ".join(["'Patient reports '", _pick(k, SYMPTOMS), "'. Plan: rest and fluids for the next weeks, '",
                           "'continue '", _pick(c, DRUGS), "' as needed, return when '", _pick(c, SYMPTOMS), "' persists.'"])
    return f"CASE {k} % 10 WHEN 8 THEN {undated} WHEN 9 THEN 'No complaints.' ELSE {full} END"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient_id"),
                                                    F.expr(note_sql(True)).alias("text"))


SQL_NOTES = f"notes AS (SELECT o_orderkey AS doc_id, o_custkey AS patient_id, {note_sql(False)} AS text FROM orders)"
