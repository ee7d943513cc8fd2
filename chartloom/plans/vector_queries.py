"""Registered vector store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions.spans import spread
from chartloom.operators import timeline as T
from chartloom.operators import vectors as V
from chartloom.plans.chunk_queries import (_SQL_CHUNKS, _SQL_DATED, _SQL_SUMMARY, _WORDS, _rounded_entries,
                                           _sql_date, dated_chunks)
from chartloom import lexicons as L
from chartloom.plans import sqltext as X
from chartloom.plans.registry import query, table
from chartloom.plans.stores import halves, stored
from chartloom.session import materialize

_TITLES = [("Symptoms", "symptoms"), ("Tests", "tests"), ("Medications", "medications"), ("Diagnoses", "diagnoses"),
           ("Procedures", "procedures")]


@query("v01_timeline_documents", f"""WITH {_SQL_SUMMARY},
ls AS (SELECT patient_id, visit_day, {', '.join(f"count(value) FILTER (kind = '{k}') AS {k}" for k in T.FACTS)} FROM entry LEFT JOIN fset USING (patient_id, visit_day) GROUP BY ALL)
SELECT 'timeline_' || h.patient_id AS id, h.patient_id, 'timeline' AS kind, total_visits::INT AS n_visits, length(summary) AS size, NULL::INT AS symptoms_count, NULL::INT AS diagnoses_count
FROM header h JOIN summaries USING (patient_id)
UNION ALL SELECT 'entry_' || patient_id || '_' || (row_number() OVER (PARTITION BY patient_id ORDER BY visit_day) - 1), patient_id, 'entry', 1, NULL, symptoms::INT, diagnoses::INT FROM ls""")
def v01(spark, sf):
    e = materialize(_rounded_entries(spark, sf))
    h = T.summary(T.threshold_report(e, ["patient_id"], 0.9), e, ["patient_id"], 0.9)
    out = V.timeline_documents(h, e)
    return out.select("id", "patient_id", "kind", "n_visits", F.when(F.col("kind") == "timeline", F.length("document")).alias("size"),
                      "symptoms_count", "diagnoses_count")


@query("v02_chunk_documents", f"""WITH {_SQL_CHUNKS}
SELECT 'chunk_' || patient_id || '_' || doc_id || '_visit_chunk_' || number AS id, length(body) AS char_count, {_WORDS.format('body')} AS word_count,
  {_sql_date('body')}::DATE::VARCHAR AS visit_date, (SELECT count(*) FROM spans x WHERE x.doc_id = c.doc_id AND x.start >= s AND x.start < e) AS entities_count FROM chunks c""")
def v02(spark, sf):
    docs = V.chunk_documents(dated_chunks(spark, sf))
    return docs.select("id", "char_count", "word_count", F.substring("visit_date", 1, 10).alias("visit_date"), "entities_count")


def _corpus(spark, sf):
    return spread(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("id"), "embedding", "label")


_DOT = "list_sum(list_transform(range(1, 65), lambda k: {0}[k]::DOUBLE * {1}[k]::DOUBLE))"
_SQL_CENTROIDS = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
cen AS (SELECT label AS query_id, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM (
  SELECT label, unnest(v) AS x, unnest(range(len(v))) AS d FROM e) GROUP BY label, d) GROUP BY label)"""


def _sql_nearest(distance, k):
    return f"""SELECT query_id, id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank
FROM (SELECT query_id, e.id, {distance} AS d FROM cen JOIN e ON true)) WHERE rank <= {k}"""


@query("v03_nearest_cosine", f"WITH {_SQL_CENTROIDS} " + _sql_nearest("1 - list_cosine_similarity(cen.v, e.v)", 5))
def v03(spark, sf):
    """The five vectors closest to the mean of each label, over the whole table."""
    corpus = _corpus(spark, sf)
    queries = V.centroids(corpus, "label").withColumnRenamed("label", "query_id")
    return V.nearest(corpus, queries, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("v03_nearest_euclidean", f"WITH {_SQL_CENTROIDS} " + _sql_nearest("list_distance(cen.v, e.v) * list_distance(cen.v, e.v)", 10))
def v03_euclidean(spark, sf):
    corpus = _corpus(spark, sf)
    queries = V.centroids(corpus, "label").withColumnRenamed("label", "query_id")
    return V.nearest(corpus, queries, 10, "euclidean").select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _store(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("timeline_"), F.col("o_custkey").cast("string"), F.lit("_"), F.year("o_orderdate").cast("string")).alias("id"),
                    F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("total"))


_SQL_STORE = """raw AS (SELECT 'timeline_' || o_custkey || '_' || year(o_orderdate) AS id, o_custkey AS patient_id, o_orderkey AS version, o_totalprice AS total FROM orders),
store AS (SELECT id, arg_max(patient_id, version) AS patient_id, max(version) AS version, arg_max(total, version) AS total FROM raw GROUP BY id)"""


def _filled(spark, sf):
    """The rows up to the mean version stored, then the later ones merged into them."""
    return stored("timelines", halves(_store(spark, sf), "version"), lambda old, new: V.upsert(new.limit(0) if old is None else old, new), ["id"])


def _upserted(spark, sf):
    return _filled(spark, sf).read()


@query("v04_lookup_latest", f"WITH {_SQL_STORE} SELECT * FROM store WHERE id IN (SELECT 'timeline_' || c_custkey || '_1999' FROM customer)")
def v04(spark, sf):
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("timeline_"), F.col("c_custkey").cast("string"), F.lit("_1999")).alias("id"))
    return _upserted(spark, sf).join(wanted, "id", "left_semi")


@query("v05_page", f"WITH {_SQL_STORE} SELECT * FROM store ORDER BY patient_id, id LIMIT 10 OFFSET 20")
def v05(spark, sf):
    return V.page(_upserted(spark, sf), ["patient_id", "id"], 10, 20)


@query("v06_count", f"WITH {_SQL_STORE} SELECT count(*) AS n FROM store")
def v06(spark, sf):
    return _upserted(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("v07_delete_timelines", f"WITH {_SQL_STORE} SELECT * FROM store WHERE patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def v07(spark, sf):
    store = _filled(spark, sf)
    gone = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("patient_id"))
    store.delete(store.read().join(gone, "patient_id", "left_semi"))
    return store.read()


def _chunk_store(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("patient_id"), F.col("l_orderkey").alias("doc_id"),
                                               F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("part"))


@query("v08_chunk_pages", """SELECT patient_id, doc_id, chunk, part, rank::INT AS rank FROM (SELECT l_suppkey AS patient_id, l_orderkey AS doc_id, l_linenumber AS chunk, l_partkey AS part,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank > 5 AND rank <= 20""")
def v08(spark, sf):
    """The second page of the chunks of every patient."""
    return V.page_per_key(_chunk_store(spark, sf), "patient_id", ["doc_id", "chunk", "part"], 15, 5)


@query("v09_chunk_counts", "SELECT l_suppkey AS patient_id, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def v09(spark, sf):
    return _chunk_store(spark, sf).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query("v10_delete_chunks", """SELECT l_suppkey AS patient_id, count(*) AS kept FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_suppkey""")
def v10(spark, sf):
    gone = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("patient_id"))
    return V.delete(_chunk_store(spark, sf), gone).groupBy("patient_id").agg(F.count(F.lit(1)).alias("kept"))


_SQL_LISTS = ", ".join(f"coalesce(string_agg(value, ', ' ORDER BY value) FILTER (kind = '{k}'), '') AS {k}" for _, k in _TITLES)


@query("v11_entry_texts", f"""WITH {_SQL_DATED},
l AS (SELECT patient_id, visit_day, {_SQL_LISTS} FROM entry LEFT JOIN fset USING (patient_id, visit_day) GROUP BY ALL),
nt AS (SELECT patient_id, visit_day, string_agg(CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '...' ELSE body END, ', ' ORDER BY doc_id, s) AS notes
  FROM dated WHERE {X.contains_any('lower(body)', L.FACT_NOTES)} GROUP BY ALL)
SELECT patient_id, visit_day::VARCHAR AS visit_day, concat_ws(' ', 'Date: ' || visit_day, {', '.join(f"'{t}: ' || {k}" for t, k in _TITLES)}, 'Notes: ' || coalesce(notes, '')) AS text
FROM l LEFT JOIN nt USING (patient_id, visit_day)""")
def v11(spark, sf):
    e = T.entries(dated_chunks(spark, sf), ["patient_id"], ["doc_id", "start_index"])
    return e.select("patient_id", F.col("visit_day").cast("string").alias("visit_day"), T.entry_text().alias("text"))


@query("v12_group_cohesion", f"""WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS cohesion, (SELECT count(*) FROM e c WHERE c.label = a.label) AS n FROM e a JOIN e b ON a.label = b.label GROUP BY a.label""")
def v12(spark, sf):
    return V.group_cohesion(_corpus(spark, sf), "label").withColumn("cohesion", F.round("cohesion", 6))
