"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.lexicons import ENTITY_RELATIONS, ENTITY_ROUTES, NODE_LABELS, NODE_MERGE, RELATION_TYPES
from chartloom.operators import graph as G
from chartloom.plans import star
from chartloom.plans.registry import query, table
from chartloom.plans.stores import halves, stored
from chartloom.plans.star import (SQL_EDGES, SQL_GRAPH, SQL_INTERACTIONS, SQL_PATIENTS,
                                  SQL_RAW_EDGES, SQL_TREATMENTS, SQL_VISITS)


def _joined(df, *names):
    return df.select(*[F.array_join(c, "|").alias(c) if c in names else c for c in df.columns])


def _star(spark, sf):
    return star.patients(spark, sf), star.visits(spark, sf), star.edges(spark, sf)


@query("g01_patient_upsert", """
WITH rows AS (
  SELECT c_custkey AS id, 0 AS age, NULL::BIGINT AS seq, c_name AS name, c_mktsegment AS gender, NULL AS phone FROM customer
  UNION ALL
  SELECT o_custkey, 1, o_orderkey, NULL, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END,
         CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR END FROM orders)
SELECT id, arg_max(name, age * 1000000000000 + coalesce(seq, 0)) FILTER (name IS NOT NULL) AS name,
       arg_max(gender, age * 1000000000000 + coalesce(seq, 0)) FILTER (gender IS NOT NULL) AS gender,
       arg_max(phone, age * 1000000000000 + coalesce(seq, 0)) FILTER (phone IS NOT NULL) AS phone
FROM rows GROUP BY id""")
def g01(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                F.col("c_mktsegment").alias("gender"),
                                                F.lit(None).cast("string").alias("phone"))
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.lit(None).cast("string").alias("name"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("gender"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).alias("phone"))
    return G.merge_last_non_null(nodes, updates, ["id"], "seq", ["name", "gender", "phone"])


@query("g02_visit_upsert", """
WITH u AS (
  SELECT l_orderkey AS id, row(l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k,
         CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS notes,
         CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS visit_type FROM lineitem),
last AS (SELECT id, arg_max(row(notes, visit_type), k) AS r FROM u GROUP BY id),
m AS (SELECT o_orderkey AS id, l.id IS NOT NULL AS has, l.r[1] AS n, l.r[2] AS t,
             o_orderstatus AS sn, o_orderpriority AS st FROM orders LEFT JOIN last l ON l.id = o_orderkey)
SELECT id, CASE WHEN has THEN n ELSE sn END AS notes,
       coalesce(CASE WHEN has THEN t ELSE st END, 'unknown') AS visit_type FROM m""")
def g02(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("notes"),
                                              F.col("o_orderpriority").alias("visit_type"))
    updates = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("seq"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("notes"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("visit_type"))
    return G.merge_latest(nodes, updates, ["id"], "seq", ["notes", "visit_type"], {"visit_type": "unknown"})


_LABELS = {"DIAGNOSED_WITH": "Disease", "PRESCRIBED": "DRUG", "PERFORMED": "LAB_VALUE", "UNDERWENT": "Allergy"}
_SQL_LABEL = ("CASE type WHEN 'DIAGNOSED_WITH' THEN 'Disease' WHEN 'PRESCRIBED' THEN 'DRUG' "
              "WHEN 'PERFORMED' THEN 'LAB_VALUE' ELSE 'Allergy' END")


def _sql_case(table, key, default):
    return ("CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
            + f" ELSE {default} END")


def _entities(spark, sf):
    label = F.element_at(F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv]), F.col("type"))
    return star.raw_edges(spark, sf).select(label.alias("label"), F.col("name").alias("text"), "confidence", "seq",
                                            "edge_date", "part_id", "facility_id", "visit_id")


@query("g03_entity_routing", f"""
WITH {SQL_RAW_EDGES}, e AS (SELECT {_SQL_LABEL} AS label, name AS text FROM raw_edges)
SELECT sha256(lower(label) || '|' || text) AS id, {_sql_case(ENTITY_ROUTES, 'upper(label)', 'upper(label)')} AS node_type,
       text, count(*) AS mentions FROM e GROUP BY ALL""")
def g03(spark, sf):
    return (G.route_entities(_entities(spark, sf)).groupBy("id", "node_type", "text")
            .agg(F.count(F.lit(1)).alias("mentions")))


def _register_entity_merge(name, relation, node, label):
    """Merge rule of a node label: declared defaults, and which confidences keep their maximum."""
    defaults, kept = NODE_MERGE[node]
    score = "confidence_score" in kept
    score_sql = (""", CASE WHEN arg_min(row(confidence_score), k)[1] IS NULL THEN CASE WHEN max(confidence_score) > 0 THEN max(confidence_score) END
       ELSE max(confidence_score) END AS confidence_score""" if score else "")
    default_sql = ", ".join(f"'{v}' AS {k}" for k, v in defaults.items())

    @query(name, f"""
WITH {SQL_RAW_EDGES},
u AS (SELECT sha256(lower('{label}') || '|' || name) AS id, name, visit_id, row(visit_id, edge_date, seq, part_id, facility_id) AS k,
             nullif(confidence, 0.07) AS confidence, nullif(quantity, 7) / 50.0 AS confidence_score FROM raw_edges WHERE type = '{relation}')
SELECT id, arg_min(name, k) AS name, arg_min(visit_id, k) AS first_visit, {default_sql + ', ' if default_sql else ''}
       CASE WHEN arg_min(row(confidence), k)[1] IS NULL THEN NULL ELSE max(confidence) END AS confidence{score_sql}
FROM u GROUP BY id""")
    def run(spark, sf):
        e = star.raw_edges(spark, sf).filter(F.col("type") == relation)
        updates = e.select(G.entity_id(F.lit(label), F.col("name")).alias("id"), "name",
                           F.col("visit_id").alias("first_visit"),
                           *[F.lit(None).cast("string").alias(d) for d in defaults],
                           F.struct("visit_id", "edge_date", "seq", "part_id", "facility_id").alias("seq"),
                           F.nullif(F.col("confidence"), F.lit(0.07)).alias("confidence"),
                           (F.nullif(F.col("quantity").cast("double"), F.lit(7.0)) / 50.0).alias("confidence_score"))
        attrs = ["name", "first_visit", *defaults]

        def merge(old, new):
            return G.merge_first_keep_max(new.limit(0) if old is None else old, new, ["id"], "seq", attrs, kept, defaults)

        return stored(name, halves(updates, "first_visit"), merge, ["id"]).read()
    return run


_register_entity_merge("g04_condition_merge", "DIAGNOSED_WITH", "Condition", "CONDITION")
_register_entity_merge("g05_medication_merge", "PRESCRIBED", "Medication", "MEDICATION")
_register_entity_merge("g06_test_merge", "PERFORMED", "Test", "TEST")
_register_entity_merge("g07_procedure_merge", "UNDERWENT", "Procedure", "PROCEDURE")


@query("g08_generic_merge", """
WITH u AS (SELECT 'Facility' AS label, 'nation:' || s_nationkey AS id, s_name AS name, s_suppkey AS seq, s_acctbal AS confidence FROM supplier)
SELECT label, id, coalesce(n_name, arg_min(name, seq)) AS name, greatest(max(u.confidence), 0.5) AS confidence
FROM u JOIN nation ON id = 'nation:' || n_nationkey GROUP BY label, id, n_name
UNION ALL
SELECT 'Facility', 'nation:' || n_nationkey, n_name, 0.5 FROM nation
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def g08(spark, sf):
    nodes = table(spark, sf, "nation").select(F.lit("Facility").alias("label"),
                                              F.concat(F.lit("nation:"), "n_nationkey").alias("id"),
                                              F.col("n_name").alias("name"), F.lit(0.5).alias("confidence"))
    updates = table(spark, sf, "supplier").select(F.lit("Facility").alias("label"),
                                                  F.concat(F.lit("nation:"), "s_nationkey").alias("id"),
                                                  F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"),
                                                  F.col("s_acctbal").alias("confidence"))
    return G.merge_first_keep_max(nodes, updates, ["label", "id"], "seq", ["name"])


@query("g09_relation_types", f"""
WITH {SQL_RAW_EDGES}, e AS (SELECT upper({_SQL_LABEL}) AS label FROM raw_edges)
SELECT label, {_sql_case(ENTITY_RELATIONS, 'label', "'RELATED_TO'")} AS relation,
  CASE WHEN label = 'LAB_VALUE' THEN 'PERFORMED' ELSE {_sql_case(ENTITY_RELATIONS, 'label', "'RELATED_TO'")} END AS loose_relation,
  count(*) AS n FROM e GROUP BY ALL""")
def g09(spark, sf):
    e = _entities(spark, sf)
    return (e.select(F.upper("label").alias("label"), G.relation_of(F.col("label")).alias("relation"),
                     G.relation_of(F.col("label"), strict=False).alias("loose_relation"))
            .groupBy("label", "relation", "loose_relation").agg(F.count(F.lit(1)).alias("n")))


@query("g10_edge_merge", f"""
WITH {SQL_RAW_EDGES}, ok AS (
  SELECT * FROM raw_edges WHERE visit_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  AND name IN (SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT s_name FROM supplier WHERE s_acctbal > 0))
SELECT visit_id::VARCHAR AS src, type, name AS dst,
       arg_min(confidence, row(edge_date, seq, part_id, facility_id)) AS confidence,
       arg_min(quantity, row(edge_date, seq, part_id, facility_id)) AS quantity FROM ok GROUP BY ALL""")
def g10(spark, sf):
    new = star.raw_edges(spark, sf).select(F.col("visit_id").cast("string").alias("src"), "type",
                                           F.col("name").alias("dst"),
                                           F.struct("edge_date", "seq", "part_id", "facility_id").alias("seq"),
                                           "confidence", "quantity")
    sources = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("src"))
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier").filter("s_acctbal > 0")
    targets = (p.select(F.col("p_name").alias("dst")).union(p.select("p_type")).union(s.select("s_name")))

    def merge(old, part):
        return G.merge_edges(part.limit(0) if old is None else old, part, sources, targets, "seq", ["confidence", "quantity"])

    day = F.unix_date(F.col("seq.edge_date").cast("date"))
    parts = [p.drop("day") for p in halves(new.withColumn("day", day), "day")]
    return stored("edges", parts, merge, ["src", "type", "dst"]).read()


_SQL_CUSTOM = """SELECT l_suppkey AS src, l_partkey AS dst,
  CASE l_returnflag WHEN 'R' THEN 'CONTRAINDICATED_WITH' WHEN 'N' THEN 'UNKNOWN_TYPE' END AS type FROM lineitem"""


@query("g11_custom_relations", f"""
WITH r AS ({_SQL_CUSTOM}), t AS (SELECT src, dst, coalesce(type, 'RELATED_TO') AS type FROM r)
SELECT type, type IN ({', '.join(f"'{t}'" for t in RELATION_TYPES)}) AS accepted, count(*) AS n,
       count(DISTINCT (src, dst)) AS edges FROM t GROUP BY ALL""")
def g11(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "CONTRAINDICATED_WITH").when(F.col("l_returnflag") == "N", "UNKNOWN_TYPE")
    req = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"),
                                              kind.alias("type"))
    good, bad = G.custom_relations(req)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("type", "accepted").agg(F.count(F.lit(1)).alias("n"),
                                                F.count_distinct("src", "dst").alias("edges"))


_SQL_STATS = """
pe AS (SELECT DISTINCT patient_id, type, name FROM edges JOIN visits USING (visit_id)),
stats AS (SELECT p.patient_id, (SELECT count(*) FROM visits v WHERE v.patient_id = p.patient_id) AS visits,
  count(*) FILTER (type = 'DIAGNOSED_WITH') AS conditions, count(*) FILTER (type = 'PRESCRIBED') AS medications,
  count(*) FILTER (type = 'PERFORMED') AS tests, count(*) FILTER (type = 'UNDERWENT') AS procedures
  FROM patients p LEFT JOIN pe USING (patient_id) GROUP BY p.patient_id)"""


@query("g12_patient_statistics", f"WITH {SQL_GRAPH}, {_SQL_STATS} SELECT * FROM stats")
def g12(spark, sf):
    return G.patient_statistics(*_star(spark, sf))


@query("g13_patient_graph", f"""
WITH {SQL_GRAPH}, {_SQL_STATS}
SELECT s.patient_id, name, s.visits, 0::BIGINT AS conditions, 0::BIGINT AS medications, s.tests, s.procedures,
  (SELECT string_agg(type || ':' || pe.name, '|' ORDER BY type, pe.name) FROM pe WHERE pe.patient_id = s.patient_id) AS entities
FROM stats s JOIN patients USING (patient_id)""")
def g13(spark, sf):
    df = G.patient_graph(*_star(spark, sf))
    pairs = F.transform("entities", lambda e: F.concat_ws(":", e["relationship"], e["entity"]))
    return df.select("patient_id", "name", "visits", "conditions", "medications", "tests", "procedures",
                     F.array_join(pairs, "|").alias("entities"))


_SQL_NODES = """nodes AS (
  SELECT 'Patient' AS label, patient_id::VARCHAR AS id FROM patients UNION ALL SELECT 'Visit', visit_id::VARCHAR FROM visits
  UNION ALL SELECT DISTINCT CASE type WHEN 'DIAGNOSED_WITH' THEN 'Condition' WHEN 'PRESCRIBED' THEN 'Medication'
    WHEN 'PERFORMED' THEN 'Test' ELSE 'Procedure' END, name FROM edges)"""


def _nodes(spark, sf):
    p, v, e = _star(spark, sf)
    label = (F.when(F.col("type") == "DIAGNOSED_WITH", "Condition").when(F.col("type") == "PRESCRIBED", "Medication")
             .when(F.col("type") == "PERFORMED", "Test").otherwise("Procedure"))
    return (p.select(F.lit("Patient").alias("label"), F.col("patient_id").cast("string").alias("id"))
            .union(v.select(F.lit("Visit"), F.col("visit_id").cast("string")))
            .union(e.select(label.alias("label"), "name").distinct()))


@query("g14_graph_statistics", f"""
WITH {SQL_GRAPH}, {_SQL_NODES}, links AS (SELECT type FROM edges UNION ALL SELECT 'HAS_VISIT' FROM visits)
SELECT 'node' AS kind, label AS name, count(*) AS count FROM nodes GROUP BY label
UNION ALL SELECT 'relationship', type, count(*) FROM links GROUP BY type
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'relationships', count(*) FROM links""")
def g14(spark, sf):
    v, e = star.visits(spark, sf), star.edges(spark, sf)
    links = e.select("type").unionAll(v.select(F.lit("HAS_VISIT").alias("type")))
    return G.graph_statistics(_nodes(spark, sf), links)


@query("g15_temporal_edges", f"""
WITH {SQL_GRAPH}, pe AS (SELECT DISTINCT patient_id, name FROM edges JOIN visits USING (visit_id)),
req AS (SELECT o_custkey AS patient_id, p_name AS entity1, p_type AS entity2,
        CASE WHEN l_returnflag = 'R' THEN l_discount + 0.0 END AS causality_confidence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT r.patient_id, entity1, entity2, a.name IS NOT NULL AND b.name IS NOT NULL AS created,
       count(*) AS n, round(max(coalesce(causality_confidence, 0.5)), 6) AS causality_confidence
FROM req r LEFT JOIN pe a ON a.patient_id = r.patient_id AND a.name = entity1
LEFT JOIN pe b ON b.patient_id = r.patient_id AND b.name = entity2 GROUP BY ALL""")
def g15(spark, sf):
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    req = (li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
           .select(F.col("o_custkey").alias("patient_id"), F.col("p_name").alias("entity1"),
                   F.col("p_type").alias("entity2"),
                   F.when(F.col("l_returnflag") == "R", F.col("l_discount") + F.lit(0.0)).alias("causality_confidence")))
    out = G.temporal_edges(req, star.visits(spark, sf), star.edges(spark, sf))
    return out.groupBy("patient_id", "entity1", "entity2", "created").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("causality_confidence"), 6).alias("causality_confidence"))


_SQL_TIMELINE = """timeline AS (
  SELECT v.patient_id, v.visit_id, v.visit_date, v.visit_type,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (type = 'DIAGNOSED_WITH'), '') AS conditions,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (type = 'PRESCRIBED'), '') AS medications,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (type = 'PERFORMED'), '') AS tests,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (type = 'UNDERWENT'), '') AS procedures
  FROM visits v LEFT JOIN edges e USING (visit_id) GROUP BY ALL)"""


@query("g16_visit_timeline", f"""
WITH {SQL_GRAPH}, {_SQL_TIMELINE}
SELECT patient_id, visit_id, visit_date::VARCHAR AS visit_date, visit_type, conditions, medications, tests, procedures FROM timeline""")
def g16(spark, sf):
    _, v, e = _star(spark, sf)
    df = G.visit_timeline(v, e).withColumn("visit_date", F.col("visit_date").cast("string"))
    return _joined(df, "conditions", "medications", "tests", "procedures")


_SQL_PATTERNS = """
cv AS (SELECT name AS condition, visit_id, patient_id, visit_date FROM edges JOIN visits USING (visit_id) WHERE type = 'DIAGNOSED_WITH'),
rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY visit_date DESC, patient_id) AS rank
         FROM (SELECT DISTINCT condition, patient_id, visit_date FROM cv)) WHERE rank <= 100)"""


@query("g17_pattern_rows", f"WITH {SQL_GRAPH}, {_SQL_PATTERNS} "
       "SELECT condition, patient_id, visit_date::VARCHAR AS visit_date, rank::INT AS rank FROM rows")
def g17_rows(spark, sf):
    _, v, e = _star(spark, sf)
    return G.pattern_rows(v, e).withColumn("visit_date", F.col("visit_date").cast("string"))


@query("g17_cross_patient_patterns", f"""
WITH {SQL_GRAPH}, {_SQL_PATTERNS},
seen AS (SELECT DISTINCT condition, patient_id, visit_date, e.type, e.name FROM cv
  JOIN rows USING (condition, patient_id, visit_date) JOIN edges e USING (visit_id) WHERE e.type IN ('PRESCRIBED', 'PERFORMED')),
c AS (SELECT condition, type, name, count(*) AS n FROM seen GROUP BY ALL)
SELECT condition, type, name, n, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY condition, type ORDER BY n DESC, name) AS rank FROM c) WHERE rank <= 10""")
def g17(spark, sf):
    _, v, e = _star(spark, sf)
    return G.cross_patient_patterns(v, e)


@query("g18_concepts", """
WITH c AS (SELECT 'concept:' || s_nationkey AS id, CASE WHEN s_acctbal >= 0 THEN s_name END AS name, s_suppkey AS seq,
  s_acctbal AS confidence, 'region:' || (n_regionkey + CASE WHEN s_acctbal > 9000 THEN 5 ELSE 0 END) AS target
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
good AS (SELECT * FROM c WHERE name IS NOT NULL)
SELECT id, arg_min(name, seq) AS name, 'general' AS category, max(confidence) AS confidence,
  count(DISTINCT target) FILTER (target IN (SELECT 'region:' || r_regionkey FROM region)) AS relations,
  (SELECT count(*) FROM c WHERE name IS NULL AND c.id = good.id) AS errors FROM good GROUP BY id""")
def g18(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    src = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    concepts = src.select(F.concat(F.lit("concept:"), "s_nationkey").alias("id"),
                          F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name"),
                          *[F.lit(None).cast("string").alias(c) for c in ("category", "description", "source")],
                          F.col("s_suppkey").alias("seq"), F.col("s_acctbal").alias("confidence"),
                          F.concat(F.lit("region:"), F.col("n_regionkey")
                                   + F.when(F.col("s_acctbal") > 9000, 5).otherwise(0)).alias("dst"))
    merged, errors = G.expand_concepts(concepts, concepts.limit(0))
    regions = table(spark, sf, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("dst"))
    new = concepts.filter("name IS NOT NULL").select(F.col("id").alias("src"), "dst", "seq",
                                                     F.lit("KNOWLEDGE_RELATES_TO").alias("type"),
                                                     F.lit(0.8).alias("confidence"))
    links = G.merge_edges(new.limit(0), new, merged.select(F.col("id").alias("src")), regions, "seq", ["confidence"])
    counts = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("relations"))
    bad = errors.groupBy("id").agg(F.count(F.lit(1)).alias("errors"))
    return (merged.select("id", "name", "category", "confidence").join(counts, "id", "left")
            .join(bad, "id", "left").fillna(0, ["relations", "errors"]))


_SQL_PAIRS = f"""{SQL_INTERACTIONS},
pairs AS (SELECT patient_id, visit_id, a.name AS drug1, b.name AS drug2,
  EXISTS (SELECT 1 FROM interactions i WHERE i.drug1 = least(a.name, b.name) AND i.drug2 = greatest(a.name, b.name)) AS has_interaction
  FROM visits JOIN edges a USING (visit_id) JOIN edges b USING (visit_id)
  WHERE a.type = 'PRESCRIBED' AND b.type = 'PRESCRIBED' AND a.name <> b.name)"""


@query("g19_interacting_pairs", f"WITH {SQL_GRAPH}, {_SQL_PAIRS} SELECT * FROM pairs WHERE has_interaction")
def g19(spark, sf):
    _, v, e = _star(spark, sf)
    return G.interacting_prescriptions(v, e, star.interactions(spark, sf))


@query("g19_co_prescription_counts", f"""
WITH {SQL_GRAPH}, {_SQL_PAIRS}
SELECT v.patient_id, coalesce(n, 0)::BIGINT AS pairs, coalesce(k, 0)::BIGINT AS interacting_pairs
FROM (SELECT DISTINCT patient_id FROM visits JOIN edges USING (visit_id) WHERE type = 'PRESCRIBED') v
LEFT JOIN (SELECT patient_id, count(*) AS n, count(*) FILTER (has_interaction) AS k FROM pairs GROUP BY 1) USING (patient_id)""")
def g19_counts(spark, sf):
    _, v, e = _star(spark, sf)
    return G.co_prescription_counts(v, e, star.interactions(spark, sf))


_SQL_GAPS = f"""{SQL_TREATMENTS},
gaps AS (SELECT patient_id, c.name AS condition, count(t.medication) AS prescribed_treatments,
  CASE WHEN count(t.medication) = 0 THEN 'Treatment Gap' ELSE 'Treated' END AS status
  FROM visits JOIN edges c USING (visit_id) LEFT JOIN
    (SELECT visit_id, condition, medication FROM edges JOIN treatments ON name = medication WHERE type = 'PRESCRIBED') t
    ON t.visit_id = c.visit_id AND t.condition = c.name
  WHERE c.type = 'DIAGNOSED_WITH' GROUP BY patient_id, c.name)"""


@query("g20_care_gaps", f"WITH {SQL_GRAPH}, {_SQL_GAPS} SELECT * FROM gaps")
def g20(spark, sf):
    _, v, e = _star(spark, sf)
    return G.care_gaps(v, e, star.treatments(spark, sf))


@query("g21_patient_bundle", f"""
WITH {SQL_GRAPH}, {_SQL_STATS}, {_SQL_PAIRS}, {_SQL_GAPS},
pc AS (SELECT patient_id, count(*) AS n, count(*) FILTER (has_interaction) AS k FROM pairs GROUP BY 1),
gc AS (SELECT patient_id, count(*) AS n, count(*) FILTER (status = 'Treatment Gap') AS g FROM gaps GROUP BY 1)
SELECT stats.*, coalesce(pc.n, 0) AS pairs, coalesce(pc.k, 0) AS interacting_pairs,
       coalesce(gc.n, 0) AS condition_rows, coalesce(gc.g, 0) AS gaps
FROM stats LEFT JOIN pc USING (patient_id) LEFT JOIN gc USING (patient_id)""")
def g21(spark, sf):
    return G.patient_bundle(*_star(spark, sf), star.interactions(spark, sf), star.treatments(spark, sf))


_ADHOC = """SELECT v.visit_type, e.type, count(*) AS n FROM graph_visits v JOIN graph_edges e ON v.visit_id = e.visit_id
WHERE v.visit_status = :status GROUP BY v.visit_type, e.type"""


@query("g22_adhoc_query", f"""
WITH {SQL_GRAPH} SELECT visit_type, type, count(*) AS n FROM visits JOIN edges USING (visit_id)
WHERE visit_status = 'F' GROUP BY ALL""")
def g22(spark, sf):
    _, v, e = _star(spark, sf)
    return G.run_query(spark, {"graph_visits": v, "graph_edges": e}, _ADHOC, {"status": "F"}, 1000)


@query("g23_batch_operations", """
WITH stored AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 2000),
ops AS (SELECT o_orderkey AS seq, o_custkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'CREATE'
  WHEN o_orderpriority = '2-HIGH' THEN 'MERGE' ELSE 'UPDATE' END AS op,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders),
born AS (SELECT id, min(seq) AS b FROM ops WHERE op <> 'UPDATE' GROUP BY id),
j AS (SELECT ops.*, s.id IS NOT NULL OR coalesce(b < seq, false) AS ex FROM ops LEFT JOIN born USING (id) LEFT JOIN stored s USING (id)),
e AS (SELECT *, CASE WHEN op = 'CREATE' AND ex THEN true WHEN op = 'UPDATE' AND NOT ex THEN true ELSE false END AS bad FROM j)
SELECT coalesce(s.id, g.id) AS id, s.name, g.status, coalesce(g.applied, 0) AS applied, coalesce(x.n, 0) AS errors
FROM stored s FULL JOIN (SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, count(*) AS applied FROM e WHERE NOT bad GROUP BY id) g USING (id)
LEFT JOIN (SELECT id, count(*) AS n FROM e WHERE bad GROUP BY id) x ON x.id = coalesce(s.id, g.id)""")
def g23(spark, sf):
    nodes = table(spark, sf, "customer").filter("c_acctbal >= 2000").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("status"))
    op = (F.when(F.col("o_orderpriority") == "1-URGENT", "CREATE").when(F.col("o_orderpriority") == "2-HIGH", "MERGE")
          .otherwise("UPDATE"))
    ops = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), op.alias("op"),
        F.lit(None).cast("string").alias("name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    done, errors = G.apply_batch(nodes, ops, ["name", "status"])
    failed = errors.groupBy("id").agg(F.count(F.lit(1)).alias("errors"))
    total = ops.groupBy("id").agg(F.count(F.lit(1)).alias("ops"))
    return (done.join(total, "id", "left").join(failed, "id", "left").fillna(0, ["ops", "errors"])
            .select("id", "name", "status", (F.col("ops") - F.col("errors")).alias("applied"), "errors"))


@query("g24_patient_visits", f"WITH {SQL_VISITS} SELECT patient_id, visit_id, visit_date::VARCHAR AS visit_date, visit_type "
       "FROM visits ORDER BY visit_date DESC, visit_id LIMIT 10")
def g24_visits(spark, sf):
    return (star.visits(spark, sf).orderBy(F.desc("visit_date"), "visit_id").limit(10)
            .select("patient_id", "visit_id", F.col("visit_date").cast("string").alias("visit_date"), "visit_type"))


@query("g24_patient_conditions", f"""WITH {SQL_GRAPH} SELECT DISTINCT patient_id, name AS condition FROM visits
JOIN edges USING (visit_id) WHERE type = 'DIAGNOSED_WITH' ORDER BY 1, 2 LIMIT 10""")
def g24_conditions(spark, sf):
    _, v, e = _star(spark, sf)
    return (G.patient_entities(v, e.filter("type = 'DIAGNOSED_WITH'"))
            .select("patient_id", F.col("name").alias("condition")).orderBy("patient_id", "condition").limit(10))


@query("g24_visit_medications", f"""WITH {SQL_GRAPH} SELECT visit_date::VARCHAR AS visit_date, visit_id, name AS medication
FROM visits JOIN edges USING (visit_id) WHERE type = 'PRESCRIBED' ORDER BY visits.visit_date DESC, visit_id, medication LIMIT 10""")
def g24_medications(spark, sf):
    _, v, e = _star(spark, sf)
    return (v.join(e.filter("type = 'PRESCRIBED'"), "visit_id")
            .orderBy(F.desc("visit_date"), "visit_id", "name").limit(10)
            .select(F.col("visit_date").cast("string").alias("visit_date"), "visit_id", F.col("name").alias("medication")))


@query("g24_abnormal_tests", """SELECT o_custkey AS patient_id, s_name AS test, count(*) AS abnormal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'R' AND l_linestatus = 'O' GROUP BY ALL ORDER BY abnormal DESC, patient_id, test LIMIT 10""")
def g24_abnormal(spark, sf):
    v, e = star.visits(spark, sf), star.raw_edges(spark, sf).filter("type = 'PERFORMED'")
    return (e.join(v, "visit_id").groupBy("patient_id", F.col("name").alias("test"))
            .agg(F.count(F.lit(1)).alias("abnormal"))
            .orderBy(F.desc("abnormal"), "patient_id", "test").limit(10))


@query("g24_drug_interactions", f"WITH {SQL_INTERACTIONS} SELECT * FROM interactions ORDER BY 1, 2 LIMIT 10")
def g24_interactions(spark, sf):
    return star.interactions(spark, sf).orderBy("drug1", "drug2").limit(10)


@query("g25_catalog", f"""
WITH {SQL_GRAPH}, {_SQL_NODES}, links AS (SELECT type FROM edges UNION ALL SELECT 'HAS_VISIT' FROM visits),
cat AS (SELECT 'node' AS kind, unnest([{', '.join(f"'{x}'" for x in NODE_LABELS)}]) AS name
  UNION ALL SELECT 'relationship', unnest([{', '.join(f"'{x}'" for x in RELATION_TYPES)}]))
SELECT kind, name, CASE WHEN kind = 'node' THEN (SELECT count(*) FROM nodes WHERE label = name)
  ELSE (SELECT count(*) FROM links WHERE type = name) END AS stored FROM cat""")
def g25(spark, sf):
    cat = spark.createDataFrame([("node", n) for n in NODE_LABELS] + [("relationship", t) for t in RELATION_TYPES],
                                "kind string, name string")
    v, e = star.visits(spark, sf), star.edges(spark, sf)
    links = e.select("type").unionAll(v.select(F.lit("HAS_VISIT").alias("type")))
    stats = G.graph_statistics(_nodes(spark, sf), links).withColumnRenamed("count", "stored")
    return cat.join(stats, ["kind", "name"], "left").fillna(0, ["stored"])


@query("g26_graph_build", f"""
WITH {SQL_GRAPH}
SELECT v.patient_id, count(DISTINCT v.visit_id) AS requests,
  (2 * count(DISTINCT v.visit_id) + count(e.name))::BIGINT AS nodes_created,
  (count(DISTINCT v.visit_id) + count(e.name))::BIGINT AS relationships_created,
  count(DISTINCT CASE WHEN e.type = 'DIAGNOSED_WITH' THEN e.name END) AS conditions
FROM visits v LEFT JOIN raw_edges e USING (visit_id) GROUP BY v.patient_id""")
def g26(spark, sf):
    from chartloom.plans.graph_build import build_counts
    return build_counts(star.visits(spark, sf), star.raw_edges(spark, sf))


def _built(spark, sf):
    from chartloom.plans.graph_build import build_graph
    order = F.struct("visit_id", "edge_date", "seq", "part_id", "facility_id").alias("seq")
    entities = _entities(spark, sf).select("visit_id", "label", "text", "confidence", order)
    return build_graph(star.visits(spark, sf), entities)


_SQL_BUILT = f"""{SQL_GRAPH}, en AS (SELECT visit_id, {_SQL_LABEL} AS label, name AS text, confidence, row(visit_id, edge_date, seq, part_id, facility_id) AS k FROM raw_edges),
ty AS (SELECT *, sha256(lower(label) || '|' || text) AS id, {_sql_case(ENTITY_ROUTES, 'upper(label)', 'upper(label)')} AS node_type,
  {_sql_case(ENTITY_RELATIONS, 'upper(label)', "'RELATED_TO'")} AS type FROM en)"""


@query("g26_built_nodes", f"""WITH {_SQL_BUILT}
SELECT node_type, id, arg_min(text, k) AS name, max(confidence) AS confidence FROM ty GROUP BY node_type, id
UNION ALL SELECT DISTINCT 'PATIENT', 'patient_' || patient_id, patient_id::VARCHAR, NULL FROM visits
UNION ALL SELECT DISTINCT 'VISIT', 'visit_' || visit_id, visit_id::VARCHAR, NULL FROM visits""")
def g26_nodes(spark, sf):
    return _built(spark, sf)[0].select("node_type", "id", "name", "confidence")


@query("g26_built_edges", f"""WITH {_SQL_BUILT}
SELECT 'patient_' || patient_id AS src, 'HAS_VISIT' AS type, 'visit_' || visit_id AS dst FROM visits
UNION SELECT 'visit_' || visit_id, type, id FROM ty""")
def g26_edges(spark, sf):
    return _built(spark, sf)[1]
