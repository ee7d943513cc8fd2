"""Graph evidence of questions reads the askers' part of the graph only."""

from pyspark.sql import functions as F

from chartloom.plans import retrieval_queries as Q
from chartloom.plans import star


def test_edges_of_some_visits(spark, sf):
    some = star.visits(spark, sf).filter(F.col("patient_id") % 7 == 0)
    expected = star.edges(spark, sf).join(some, "visit_id", "left_semi")
    found = star.edges(spark, sf, of=some)
    assert found.count() == expected.count() > 0
    assert found.exceptAll(expected).isEmpty()


def test_evidence_leaves_other_patients_and_conditions_out(spark, sf):
    plan = Q._evidence(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-|")) for i, line in enumerate(lines)}
    edges = [i for i, line in enumerate(lines) if "l_orderkey" in line and "Relation" in line]
    assert len(edges) == 1 and "treating_conditions" not in plan  # edges are read once, without the conditions of a visit
    above, level = [], depth[edges[0]]
    for i in range(edges[0], -1, -1):
        if depth[i] < level:
            level = depth[i]
            above.append(lines[i])
    joins = [line for line in above if "Join" in line]
    assert "LeftSemi" in joins[0]  # the visits of the askers come before parts and suppliers
