"""The star tables in clinical roles.

customer is the patient, orders the visit, a lineitem one visit-entity edge,
and part and supplier the entities.  The return flag and line status of a
lineitem decide the relation; R is the abnormal flag of a test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.columns import age_years
from chartloom.plans.registry import table

AS_OF = "2002-01-01"


def patients(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    dob = F.date_sub(F.lit(AS_OF).cast("date"), F.floor((F.col("c_acctbal") + 1000) * 3).cast("int"))
    return c.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("gender"), dob.alias("dob"),
                    age_years(dob, F.lit(AS_OF).cast("date")).cast("int").alias("age"))


SQL_PATIENTS = f"""patients AS (
  SELECT patient_id, name, gender, dob,
         (year(DATE '{AS_OF}') - year(dob)
          - CASE WHEN 101 < month(dob) * 100 + day(dob) THEN 1 ELSE 0 END)::INT AS age
  FROM (SELECT c_custkey AS patient_id, c_name AS name, c_mktsegment AS gender,
               (DATE '{AS_OF}' - floor((c_acctbal + 1000) * 3)::INT)::DATE AS dob FROM customer))"""


def visits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"),
                    F.to_date("o_orderdate").alias("visit_date"),
                    F.col("o_orderpriority").alias("visit_type"),
                    F.col("o_orderstatus").alias("visit_status"))


SQL_VISITS = """visits AS (
  SELECT o_orderkey AS visit_id, o_custkey AS patient_id, o_orderdate::DATE AS visit_date,
         o_orderpriority AS visit_type, o_orderstatus AS visit_status FROM orders)"""


def raw_edges(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """One row per lineitem: visit, relation type, entity name, attributes; with ``of`` those of its visits only."""
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    if of is not None:
        li = li.join(of.select(F.col("visit_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    kind = (F.when(F.col("l_returnflag") == "A", "PRESCRIBED")
            .when(F.col("l_returnflag") == "N", "DIAGNOSED_WITH")
            .when(F.col("l_linestatus") == "O", "PERFORMED").otherwise("UNDERWENT"))
    name = (F.when(F.col("type") == "PRESCRIBED", F.col("p_name"))
            .when(F.col("type") == "DIAGNOSED_WITH", F.col("p_type"))
            .when(F.col("type") == "PERFORMED", F.col("s_name")).otherwise(F.col("p_brand")))
    return (li.withColumn("type", kind)
            .join(p, li["l_partkey"] == p["p_partkey"])
            .join(s, li["l_suppkey"] == s["s_suppkey"])
            .select(F.col("l_orderkey").alias("visit_id"), "type", name.alias("name"),
                    (F.col("l_discount") + F.lit(0.0)).alias("confidence"),
                    F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("seq"),
                    F.to_date("l_shipdate").alias("edge_date"), F.col("l_partkey").alias("part_id"),
                    F.col("l_suppkey").alias("facility_id")))


SQL_RAW_EDGES = """raw_edges AS (
  SELECT l_orderkey AS visit_id, t AS type,
         CASE t WHEN 'PRESCRIBED' THEN p_name WHEN 'DIAGNOSED_WITH' THEN p_type
                WHEN 'PERFORMED' THEN s_name ELSE p_brand END AS name,
         l_discount + 0.0 AS confidence, l_quantity AS quantity, l_linenumber AS seq,
         l_shipdate::DATE AS edge_date, l_partkey AS part_id, l_suppkey AS facility_id
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'PRESCRIBED' WHEN l_returnflag = 'N' THEN 'DIAGNOSED_WITH'
                       WHEN l_linestatus = 'O' THEN 'PERFORMED' ELSE 'UNDERWENT' END AS t FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def edges(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Merged edges: one per (visit, relation, entity name); with ``of`` those of its visits only."""
    return raw_edges(spark, sf, of).select("visit_id", "type", "name").distinct()


SQL_EDGES = SQL_RAW_EDGES + """,
edges AS (SELECT DISTINCT visit_id, type, name FROM raw_edges)"""
SQL_GRAPH = ", ".join([SQL_PATIENTS, SQL_VISITS, SQL_EDGES])


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected medication pairs: neighbouring parts of one type."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"),
                 F.col("p_type").alias("other_type"))
    return (p.join(q, "p_partkey").filter("p_type = other_type AND p_name <> other")
            .select(F.least("p_name", "other").alias("drug1"), F.greatest("p_name", "other").alias("drug2"))
            .distinct())


SQL_INTERACTIONS = """interactions AS (
  SELECT DISTINCT least(p.p_name, q.p_name) AS drug1, greatest(p.p_name, q.p_name) AS drug2
  FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
  WHERE p.p_type = q.p_type AND p.p_name <> q.p_name)"""


def treatments(spark: SparkSession, sf: str) -> DataFrame:
    """TREATED_WITH: condition to medication."""
    return (table(spark, sf, "part").filter("p_size <= 2")
            .select(F.col("p_type").alias("condition"), F.col("p_name").alias("medication")).distinct())


SQL_TREATMENTS = """treatments AS (
  SELECT DISTINCT p_type AS condition, p_name AS medication FROM part WHERE p_size <= 2)"""
