"""From a table of visit requests to nodes, edges and per-patient counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators import graph as G


def build_graph(requests: DataFrame, entities: DataFrame, stored_nodes: DataFrame | None = None,
                strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of requests (visit_id, patient_id) and entities (visit_id, label, text, confidence, seq).

    Nodes are the patients, their visits and the routed entities; edges lead from
    patients to visits and from visits to entities.
    """
    typed = G.route_entities(entities)
    updates = typed.select("node_type", "id", F.col("text").alias("name"), "confidence", "seq")
    stored = stored_nodes if stored_nodes is not None else updates.drop("seq").limit(0)
    nodes = G.merge_first_keep_max(stored, updates, ["node_type", "id"], "seq", ["name"])
    patient, visit = F.concat(F.lit("patient_"), "patient_id"), F.concat(F.lit("visit_"), "visit_id")
    for kind, node, name in (("PATIENT", patient, "patient_id"), ("VISIT", visit, "visit_id")):
        own = requests.select(F.lit(kind).alias("node_type"), node.alias("id"), F.col(name).cast("string").alias("name"),
                              F.lit(None).cast(nodes.schema["confidence"].dataType).alias("confidence")).distinct()
        nodes = nodes.unionByName(own)
    has_visit = requests.select(patient.alias("src"), F.lit("HAS_VISIT").alias("type"), visit.alias("dst"))
    mentions = typed.select(visit.alias("src"), G.relation_of(F.col("label"), strict).alias("type"),
                            F.col("id").alias("dst"))
    return nodes, has_visit.unionByName(mentions).distinct()


def build_counts(visits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per patient what a build reports.

    Each request counts its patient, its visit and every mention as a node,
    whether or not the node existed; a mention is one visit-entity relation.
    """
    per_visit = mentions.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"))
    sums = (visits.join(per_visit, "visit_id", "left").groupBy("patient_id")
            .agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    conditions = (G.patient_entities(visits, mentions.filter("type = 'DIAGNOSED_WITH'"))
                  .groupBy("patient_id").agg(F.count(F.lit(1)).alias("conditions")))
    return (sums.join(conditions, "patient_id", "left").fillna(0, ["conditions"])
            .select("patient_id", "requests", (2 * F.col("requests") + F.col("n")).alias("nodes_created"),
                    (F.col("requests") + F.col("n")).alias("relationships_created"), "conditions"))
