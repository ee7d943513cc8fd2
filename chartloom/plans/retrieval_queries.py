"""Registered question and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions.spans import spread
from chartloom.operators import retrieval as H
from chartloom.operators import similar_cases as C
from chartloom.operators import timeline as T
from chartloom.operators import vectors as V
from chartloom.plans import sqltext as X
from chartloom.plans import star
from chartloom.plans.chunk_queries import _SQL_SUMMARY, _rounded_entries
from chartloom.plans.questions import SQL_QUESTIONS, questions
from chartloom.plans.registry import query, table
from chartloom.plans.star import SQL_GRAPH, SQL_INTERACTIONS
from chartloom.plans.vector_queries import _SQL_CENTROIDS
from chartloom.session import materialize


def _sql_intent(q):
    return "CASE " + " ".join(f"WHEN {X.contains_any(f'lower({q})', ws)} THEN '{n}'" for n, ws in L.INTENT_WORDS) + f" ELSE '{L.DEFAULT_INTENT}' END"


_SQL_COUNTS = f"""qe AS (SELECT *, len(regexp_extract_all(lower(query), 'patient[_\\s]*(\\d+|[a-z]+\\d+)', 1))
  + len(list_filter([{', '.join(X.q(w) for w in L.QUERY_CONDITIONS + L.QUERY_MEDICATIONS)}], lambda w: contains(lower(query), w))) AS n FROM questions)"""


@query("h01_intents", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_sql_intent('query')} AS intent FROM questions")
def h01(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", H.intent(F.col("query")).alias("intent"))


@query("h02_complexity", f"""WITH {SQL_QUESTIONS}, {_SQL_COUNTS} SELECT conv_id, turn, CASE WHEN n > 5 OR contains(lower(query), 'population') THEN 'advanced'
  WHEN n > 2 OR {X.contains_any('lower(query)', ['compare', 'timeline', 'progression'])} THEN 'complex' WHEN n > 0 THEN 'moderate' ELSE 'simple' END AS complexity FROM qe""")
def h02(spark, sf):
    q = H.question_entities(questions(spark, sf))
    return q.select("conv_id", "turn", H.complexity(F.col("query"), F.col("entities")).alias("complexity"))


@query("h03_cleaned", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, regexp_replace(trim(query), '\\s+', ' ', 'g') AS cleaned FROM questions")
def h03(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", H.clean_query(F.col("query")).alias("cleaned"))


def _searches(spark, sf):
    """Search vectors of each conversation: its own, its label's mean, and both reversed."""
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    means = V.centroids(corpus, "label").withColumnRenamed("embedding", "mean")
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    own = corpus.join(asked, "id").join(means, "label").withColumn("v", F.col("embedding").cast("array<double>"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("embedding")) for k, v in (
        ("patient", F.col("v")), ("condition", F.col("mean")), ("query", F.reverse("v")), ("entity", F.reverse("mean")))])
    timelines = own.select(F.col("id").alias("query_id"), F.col("id").alias("content"))
    return corpus, own.select(F.col("id").alias("query_id"), F.explode(kinds).alias("s")).select("query_id", "s.kind", "s.embedding"), timelines


_SQL_EVIDENCE = f"""{_SQL_CENTROIDS}, own AS (SELECT e.id AS query_id, e.v, cen.v AS m FROM e JOIN cen ON cen.query_id = e.label WHERE e.id IN (SELECT conv_id FROM conversations)),
search AS (SELECT query_id, 'patient' AS kind, v, 5 AS k FROM own UNION ALL SELECT query_id, 'condition', m, 3 FROM own
  UNION ALL SELECT query_id, 'query', list_reverse(v), 3 FROM own UNION ALL SELECT query_id, 'entity', list_reverse(m), 2 FROM own),
vec AS (SELECT query_id::VARCHAR AS query_id, kind, id, 1 - d AS relevance, position FROM (SELECT query_id, kind, k, id, d, row_number() OVER (PARTITION BY query_id, kind ORDER BY d, id) AS position FROM (
  SELECT s.query_id, kind, k, e.id, round(1 - list_cosine_similarity(s.v, e.v), 9) AS d FROM search s JOIN e ON true)) WHERE position <= k
  UNION ALL SELECT query_id::VARCHAR, 'timeline', query_id, 1.0, 0 FROM own)"""


@query("h04_vector_evidence", f"WITH {_SQL_EVIDENCE} SELECT query_id, kind AS result_type, id AS content, round(relevance, 6) AS relevance, position::INT AS position FROM vec")
def h04(spark, sf):
    corpus, searches, own = _searches(spark, sf)
    return H.vector_evidence(spread(corpus), searches, own=own).withColumn("relevance", F.round("relevance", 6))


def _graph(spark, sf):
    return star.patients(spark, sf), star.visits(spark, sf), star.edges(spark, sf)


_KINDS = {"conditions": "DIAGNOSED_WITH", "medications": "PRESCRIBED", "tests": "PERFORMED", "procedures": "UNDERWENT"}
_SQL_OVERVIEW = f"""pe AS (SELECT DISTINCT patient_id, type, name FROM edges JOIN visits USING (visit_id)),
ov AS (SELECT p.patient_id, p.name, (SELECT count(*) FROM visits v WHERE v.patient_id = p.patient_id) AS visits,
  (SELECT min(visit_date) FROM visits v WHERE v.patient_id = p.patient_id) AS first_visit, (SELECT max(visit_date) FROM visits v WHERE v.patient_id = p.patient_id) AS last_visit,
  {', '.join(f"coalesce(string_agg(pe.name, ', ' ORDER BY pe.name) FILTER (type = '{r}'), '') AS all_{k}, coalesce(list(pe.name ORDER BY pe.name) FILTER (type = '{r}'), []) AS l_{k}" for k, r in _KINDS.items())}
  FROM patients p LEFT JOIN pe USING (patient_id) GROUP BY p.patient_id, p.name)"""


@query("h05_patient_overview", f"WITH {SQL_GRAPH}, {_SQL_OVERVIEW} SELECT patient_id, name, visits, first_visit::VARCHAR AS first_visit, last_visit::VARCHAR AS last_visit, all_conditions, all_medications, all_tests, all_procedures FROM ov")
def h05(spark, sf):
    out = H.patient_overview(*_graph(spark, sf))
    return out.select("patient_id", "name", "visits", *[F.col(c).cast("string").alias(c) for c in ("first_visit", "last_visit")],
                      *[F.array_join(f"all_{k}", ", ").alias(f"all_{k}") for k in _KINDS])


_SQL_TREATED = """tr AS (SELECT * FROM (SELECT patient_id, visit_id, visit_date, name AS medication, row_number() OVER (PARTITION BY patient_id ORDER BY visit_date DESC, visit_id, name) AS rank
  FROM edges JOIN visits USING (visit_id) WHERE type = 'PRESCRIBED') WHERE rank <= 10),
trc AS (SELECT tr.*, coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM edges c WHERE c.visit_id = tr.visit_id AND c.type = 'DIAGNOSED_WITH'), '') AS treating FROM tr)"""


@query("h06_current_treatments", f"WITH {SQL_GRAPH}, {_SQL_TREATED} SELECT patient_id, visit_id, visit_date::VARCHAR AS visit_date, medication, treating, rank::INT AS rank FROM trc")
def h06(spark, sf):
    _, v, e = _graph(spark, sf)
    out = H.current_treatments(v, e)
    return out.select("patient_id", "visit_id", F.col("visit_date").cast("string").alias("visit_date"), "medication",
                      F.array_join("treating_conditions", ", ").alias("treating"), "rank")


_FOCUS = {"BUILDING": "ECON", "MACHINERY": "SMALL", "FURNITURE": "small", "HOUSEHOLD": "A"}
_SQL_HISTORY = f"""hs AS (SELECT * FROM (SELECT v.patient_id, v.visit_id, visit_date, e.name AS condition, focus, row_number() OVER (PARTITION BY v.patient_id ORDER BY visit_date DESC, v.visit_id, e.name) AS rank
  FROM edges e JOIN visits v USING (visit_id) JOIN (SELECT patient_id, {X.lookup('gender', _FOCUS)} AS focus FROM patients) f ON f.patient_id = v.patient_id
  WHERE type = 'DIAGNOSED_WITH' AND contains(e.name, focus)) WHERE rank <= 10),
hsl AS (SELECT hs.*, coalesce((SELECT list(name ORDER BY name) FROM edges m WHERE m.visit_id = hs.visit_id AND m.type = 'PRESCRIBED'), []) AS meds,
  coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM edges m WHERE m.visit_id = hs.visit_id AND m.type = 'PERFORMED'), '') AS tests FROM hs)"""


def _focus(p):
    table_ = F.create_map(*[F.lit(x) for kv in _FOCUS.items() for x in kv])
    return p.select("patient_id", F.element_at(table_, F.col("gender")).alias("focus")).filter(F.col("focus").isNotNull())


@query("h07_condition_history", f"WITH {SQL_GRAPH}, {_SQL_HISTORY} SELECT patient_id, visit_id, visit_date::VARCHAR AS visit_date, condition, array_to_string(meds, ', ') AS medications, tests, rank::INT AS rank FROM hsl")
def h07(spark, sf):
    p, v, e = _graph(spark, sf)
    out = H.condition_history(v, e, _focus(p))
    return out.select("patient_id", "visit_id", F.col("visit_date").cast("string").alias("visit_date"), "condition",
                      F.array_join("medications", ", ").alias("medications"), F.array_join("tests", ", ").alias("tests"), "rank")


_SQL_POPULATION = """pop AS (SELECT c.name AS condition, count(DISTINCT patient_id) AS patient_count, count(DISTINCT visit_id) AS visit_count FROM edges c JOIN visits USING (visit_id) WHERE type = 'DIAGNOSED_WITH' GROUP BY c.name),
pm5 AS (SELECT condition, list_sort(list_distinct(list(m.name)))[1:5] AS meds FROM (SELECT visit_id, name AS condition FROM edges WHERE type = 'DIAGNOSED_WITH') JOIN edges m USING (visit_id) WHERE m.type = 'PRESCRIBED' GROUP BY condition)"""


@query("h08_population", f"WITH {SQL_GRAPH}, {_SQL_POPULATION} SELECT condition, patient_count, visit_count, coalesce(array_to_string(meds, ', '), '') AS common_medications FROM pop LEFT JOIN pm5 USING (condition) ORDER BY patient_count DESC, condition LIMIT 5")
def h08(spark, sf):
    _, v, e = _graph(spark, sf)
    return H.population_rows(v, e).withColumn("common_medications", F.array_join("common_medications", ", "))


@query("h09_named_interactions", f"""WITH {SQL_GRAPH}, {SQL_INTERACTIONS}, named AS (SELECT DISTINCT patient_id AS query_id, name FROM edges JOIN visits USING (visit_id) WHERE type = 'PRESCRIBED')
SELECT a.query_id, i.drug1, i.drug2, 'INTERACTS_WITH' AS interaction_types FROM interactions i JOIN named a ON a.name = i.drug1 JOIN named b ON b.name = i.drug2 AND b.query_id = a.query_id""")
def h09(spark, sf):
    _, v, e = _graph(spark, sf)
    owners = v.select("visit_id", F.col("patient_id").alias("query_id"))
    named = e.filter("type = 'PRESCRIBED'").join(owners, "visit_id").select("query_id", F.col("name").alias("medication"))
    out = H.named_interactions(star.interactions(spark, sf).withColumn("type", F.lit("INTERACTS_WITH")), named)
    return out.withColumn("interaction_types", F.array_join("interaction_types", ","))


def _evidence(spark, sf):
    corpus, searches, own = _searches(spark, sf)
    found = H.vector_evidence(spread(corpus), searches, own=own)
    vector = H.tag(found.withColumn("note", F.concat_ws(":", "result_type", F.lpad(F.col("position").cast("string"), 2, "0"), F.col("content").cast("string"))),
                   "vector", F.col("relevance"), ["vectors", "similar"], F.col("note"))
    # only visits and edges of the askers are joined and ranked, and their conditions are not part of the evidence
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("patient_id")).distinct()
    v = star.visits(spark, sf).join(asked, "patient_id", "left_semi")
    treated = H.newest_medications(v, star.edges(spark, sf, of=v))
    graph = H.tag(treated.select(F.col("patient_id").cast("string").alias("query_id"), F.concat_ws(
        ":", F.lpad(F.col("rank").cast("string"), 2, "0"), "medication").alias("note")), "current_treatments", F.lit(1.2), ["graph", "current_treatments"], F.col("note"))
    return H.merge_evidence([vector, graph], F.col("content"))


_SQL_MERGED = f"""{SQL_GRAPH}, {_SQL_EVIDENCE},
g3 AS (SELECT patient_id::VARCHAR AS query_id, lpad(rank::VARCHAR, 2, '0') || ':' || medication AS content FROM (SELECT patient_id, name AS medication, row_number() OVER (PARTITION BY patient_id ORDER BY visit_date DESC, visit_id, name) AS rank
  FROM edges JOIN visits USING (visit_id) WHERE type = 'PRESCRIBED') WHERE rank <= 10 AND patient_id IN (SELECT conv_id FROM conversations)),
u AS (SELECT query_id, 'vector' AS result_type, least(greatest(relevance, 0), 1) AS relevance, kind || ':' || lpad(position::VARCHAR, 2, '0') || ':' || id AS content, 0 AS part FROM vec
  UNION ALL SELECT query_id, 'current_treatments', 1.0, content, 1 FROM g3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, part, content) AS rank FROM u)"""


@query("h10_merged_evidence", f"WITH {_SQL_MERGED} SELECT query_id, result_type, round(relevance, 6) AS relevance, content, rank::INT AS rank FROM ranked")
def h10(spark, sf):
    return _evidence(spark, sf).select("query_id", "result_type", F.round("relevance", 6).alias("relevance"), "content", "rank")


@query("h11_answer_confidence", f"WITH {_SQL_MERGED} SELECT query_id, round(least(0.4 * 0.8 + 0.6 * avg(relevance), 1.0), 6)::DOUBLE AS confidence FROM ranked GROUP BY query_id")
def h11(spark, sf):
    return H.answer_confidence(_evidence(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("h12_evidence_entities", f"""WITH {SQL_GRAPH} SELECT visit_id, CASE type WHEN 'DIAGNOSED_WITH' THEN 'condition' WHEN 'PRESCRIBED' THEN 'medication' ELSE 'procedure' END AS entity_type, name AS entity_value, 0.8::DOUBLE AS confidence
FROM edges WHERE type <> 'PERFORMED' AND visit_id IN (SELECT visit_id FROM visits)""")
def h12(spark, sf):
    from chartloom.operators.graph import visit_timeline
    _, v, e = _graph(spark, sf)
    return H.evidence_entities(visit_timeline(v, e), "visit_id")


@query("h13_follow_ups", f"""WITH {SQL_QUESTIONS} SELECT conv_id, turn, CASE {_sql_intent('query')} WHEN 'patient_summary' THEN '{'|'.join(L.FOLLOW_UPS['patient_summary'])}'
  WHEN 'population_health' THEN '{'|'.join(L.FOLLOW_UPS['population_health'])}' ELSE '' END AS follow_ups FROM questions""")
def h13(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", F.array_join(H.follow_ups(H.intent(F.col("query"))), "|").alias("follow_ups"))


_SQL_LINES = """tl AS (SELECT patient_id, count(*) AS n, string_agg(medication, ', ' ORDER BY rank) FILTER (rank <= 3) AS key_meds,
  string_agg('• ' || medication || CASE WHEN treating <> '' THEN ' [For: ' || treating || ']' ELSE '' END, chr(10) ORDER BY rank) AS lines FROM trc GROUP BY patient_id)"""


@query("h14_evidence_summaries", f"""WITH {SQL_GRAPH}, {_SQL_OVERVIEW}, {_SQL_TREATED}, {_SQL_LINES}
SELECT patient_id, concat_ws(chr(10), 'Patient ID: ' || patient_id, CASE WHEN visits > 0 THEN 'Total Visits: ' || visits END,
  CASE WHEN len(l_conditions) > 0 THEN 'Conditions: ' || array_to_string(l_conditions[1:3], ', ') END, CASE WHEN len(l_medications) > 0 THEN 'Medication History: ' || array_to_string(l_medications[1:3], ', ') END,
  CASE WHEN n > 0 THEN 'Active Treatments: ' || n || ' medications' END, CASE WHEN n > 0 THEN 'Key Medications: ' || key_meds END) AS summary FROM ov LEFT JOIN tl USING (patient_id)""")
def h14(spark, sf):
    p, v, e = _graph(spark, sf)
    return H.report_lines(H.patient_overview(p, v, e), H.current_treatments(v, e)).select("patient_id", "summary")


@query("h15_reports", f"""WITH {SQL_GRAPH}, {_SQL_OVERVIEW}, {_SQL_TREATED}, {_SQL_LINES}, {_SQL_HISTORY},
hl AS (SELECT patient_id, max(focus) AS focus, string_agg('• Visit on ' || visit_date || ':' || chr(10) || array_to_string(list_transform(meds, lambda m: '  - ' || m), chr(10)), chr(10) ORDER BY rank) FILTER (len(meds) > 0) AS lines FROM hsl WHERE rank <= 5 GROUP BY patient_id)
SELECT o.patient_id, 1 + CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN focus IS NOT NULL THEN 1 ELSE 0 END AS data_points, concat_ws(chr(10), '**Treatment Analysis for Patient ' || o.patient_id || '**' || chr(10),
  chr(10) || 'I''ve analyzed ' || (1 + CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN focus IS NOT NULL THEN 1 ELSE 0 END) || ' relevant data points from the medical knowledge base to answer your query.' || chr(10),
  '**Patient Overview:**', '- Patient ID: ' || o.patient_id, '- Patient Name: ' || name, CASE WHEN visits > 0 THEN '- Total Medical Visits: ' || visits END, CASE WHEN visits > 0 THEN '- Latest Visit: ' || last_visit END,
  CASE WHEN len(l_medications) > 0 THEN '- All Prescribed Medications: ' || all_medications END, CASE WHEN n > 0 THEN chr(10) || '**Current Active Treatments:**' || chr(10) || tl.lines END,
  CASE WHEN focus IS NOT NULL THEN chr(10) || '**Treatment History for ' || focus || ':**' || coalesce(chr(10) || hl.lines, '') END)
  || chr(10) || '*This analysis is based on data from: ' || CASE WHEN focus IS NOT NULL THEN 'condition_specific, ' ELSE '' END || CASE WHEN n > 0 THEN 'current_treatments, ' ELSE '' END || 'graph, patient_graph*' AS report
FROM ov o LEFT JOIN tl USING (patient_id) LEFT JOIN hl USING (patient_id)""")
def h15(spark, sf):
    p, v, e = _graph(spark, sf)
    out = H.report_lines(H.patient_overview(p, v, e), H.current_treatments(v, e), H.condition_history(v, e, _focus(p)))
    return out.select("patient_id", "data_points", "report")


_TOKENS = "list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> '')"


@query("h16_low_quality", f"""WITH t AS (SELECT a.conv_id, a.turn, a.text, b.text AS source FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
w AS (SELECT *, {_TOKENS.format('text')} AS words, list_distinct({_TOKENS.format('text')}) AS uniq, list_distinct({_TOKENS.format('source')}) AS origin FROM t)
SELECT conv_id, turn, length(trim(text)) < 10 OR len(uniq) / len(words) < 0.5 OR len(list_intersect(uniq, origin)) > len(uniq) * 0.8 OR (length(lower(text)) - length(replace(lower(text), 'patient id', ''))) / 10 > 2 AS low_quality FROM w""")
def h16(spark, sf):
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", H.low_quality(F.col("text"), F.col("source")).alias("low_quality"))


@query("h17_cleaned_texts", """WITH t AS (SELECT conv_id, turn, trim(text) AS s, string_split(trim(text), '.') AS p FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN len(p) > 1 AND length(trim(p[-1])) < 10 THEN array_to_string(p[:-2], '.') || '.' ELSE s END AS cut FROM t)
SELECT conv_id, turn, CASE WHEN length(cut) > 50 THEN cut || chr(10) || chr(10) || '*Note: This analysis is for informational purposes only.*' ELSE cut END AS cleaned FROM c""")
def h17(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", H.clean_generated(F.col("text")).alias("cleaned"))


@query("h18_population_reports", f"""WITH {SQL_GRAPH}, {_SQL_POPULATION}, q AS (SELECT *, 'Analyze population health for patients with ' || condition || ' including health trends and patterns' AS question FROM pop)
SELECT condition, question, {_sql_intent('question')} AS intent, '**Population Health Analysis**' || chr(10) || chr(10) || chr(10) || '**Population Statistics:**' || chr(10) || '- **' || condition || ':**' || chr(10) || '  - Patients: ' || patient_count || chr(10) || '  - Avg visits: ' || printf('%.1f', visit_count / patient_count::DOUBLE) AS report
FROM q ORDER BY patient_count DESC, condition LIMIT 5""")
def h18(spark, sf):
    _, v, e = _graph(spark, sf)
    return H.population_report(H.population_rows(v, e))


@query("h18_patient_reports", f"""WITH {SQL_GRAPH}, {_SQL_OVERVIEW}, {_SQL_TREATED}, {_SQL_LINES}, {_SQL_SUMMARY}
SELECT o.patient_id, 1 + CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 1 ELSE 0 END AS data_points,
  concat_ws(chr(10), 'Patient ID: ' || o.patient_id, CASE WHEN visits > 0 THEN 'Total Visits: ' || visits END,
  CASE WHEN len(l_conditions) > 0 THEN 'Conditions: ' || array_to_string(l_conditions[1:3], ', ') END, CASE WHEN len(l_medications) > 0 THEN 'Medication History: ' || array_to_string(l_medications[1:3], ', ') END,
  CASE WHEN n > 0 THEN 'Active Treatments: ' || n || ' medications' END, CASE WHEN n > 0 THEN 'Key Medications: ' || key_meds END) AS overview, concat_ws(chr(10), '**Treatment Analysis for Patient ' || o.patient_id || '**' || chr(10),
  chr(10) || 'I''ve analyzed ' || (1 + CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 1 ELSE 0 END) || ' relevant data points from the medical knowledge base to answer your query.' || chr(10),
  '**Patient Overview:**', '- Patient ID: ' || o.patient_id, '- Patient Name: ' || name, CASE WHEN visits > 0 THEN '- Total Medical Visits: ' || visits END, CASE WHEN visits > 0 THEN '- Latest Visit: ' || last_visit END,
  CASE WHEN len(l_medications) > 0 THEN '- All Prescribed Medications: ' || all_medications END, CASE WHEN n > 0 THEN chr(10) || '**Current Active Treatments:**' || chr(10) || tl.lines END,
  chr(10) || '**Clinical Timeline Summary:**' || chr(10) || '- ' || summary)
  || chr(10) || '*This analysis is based on data from: ' || CASE WHEN n > 0 THEN 'current_treatments, ' ELSE '' END || 'graph, patient_graph' || CASE WHEN summary IS NOT NULL THEN ', patient_timeline, vectors' ELSE '' END || '*' AS report
FROM ov o LEFT JOIN tl USING (patient_id) LEFT JOIN summaries USING (patient_id)""")
def h18_patients(spark, sf):
    """Overview with conditions and the whole prepared report of every patient, with the timeline part where there is a timeline."""
    p, v, e = _graph(spark, sf)
    entry_rows = materialize(_rounded_entries(spark, sf))
    summaries = T.summary(T.threshold_report(entry_rows, ["patient_id"], 0.9), entry_rows, ["patient_id"], 0.9)
    out = H.report_lines(H.patient_overview(p, v, e), H.current_treatments(v, e), summaries=summaries)
    return out.select("patient_id", "data_points", F.col("summary").alias("overview"), "report")


_PERIODS = [None, "last_12_months"]
_SQL_CASES = f"""{SQL_GRAPH}, span AS (SELECT 'all' AS period, DATE '0001-01-01' AS start UNION ALL SELECT 'last_12_months', (max(visit_date) - INTERVAL 12 MONTH)::DATE FROM visits),
tok AS (SELECT period, patient_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM visits JOIN edges USING (visit_id) JOIN span ON visit_date >= start),
tf AS (SELECT period, patient_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS d, count(*) AS n FROM tok GROUP BY ALL),
ids AS (SELECT period, count(DISTINCT patient_id) AS ids FROM tf GROUP BY period),
idf AS (SELECT period, d, ln((any_value(ids) + 1)::DOUBLE / (count(*) + 1)) + 1 AS weight FROM tf JOIN ids USING (period) GROUP BY period, d),
w AS (SELECT period, patient_id, d, n * weight AS w FROM tf JOIN idf USING (period, d)),
size AS (SELECT period, patient_id, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL),
met AS (SELECT a.period, a.patient_id, b.patient_id AS id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.period = b.period AND a.d = b.d AND a.patient_id <> b.patient_id
  WHERE a.patient_id IN (SELECT conv_id FROM conversations) GROUP BY ALL),
sim AS (SELECT met.period, met.patient_id, id, round(dot / s1.size / s2.size, 9) AS similarity FROM met JOIN size s1 ON s1.period = met.period AND s1.patient_id = met.patient_id
  JOIN size s2 ON s2.period = met.period AND s2.patient_id = id),
cases AS (SELECT *, row_number() OVER (PARTITION BY period, patient_id ORDER BY similarity DESC, id) AS rank FROM sim)"""


def _cases(spark, sf, period):
    _, v, e = _graph(spark, sf)
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("patient_id"))
    return C.patient_cases(v, e, asked, period).withColumn("period", F.lit(period or "all"))


@query("h18_similar_cases", f"""WITH {_SQL_CASES} SELECT period, patient_id, id AS similar_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM cases WHERE rank <= 5""")
def h18_similar(spark, sf):
    """The five patients most similar to each asked one, over all visits and over the last year of the table."""
    rows = [_cases(spark, sf, period) for period in _PERIODS]
    return rows[0].unionByName(rows[1]).select("period", F.col("query_id").alias("patient_id"), F.col("id").alias("similar_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("h18_patient_summaries", f"""WITH {_SQL_CASES}, {_SQL_OVERVIEW}, {_SQL_TREATED}, {_SQL_LINES},
found AS (SELECT patient_id, count(*) AS found, '**Similar Patient Cases:** ' || count(*) || ' found' || chr(10)
  || string_agg(rank || '. Similarity: ' || printf('%.2f', similarity), chr(10) ORDER BY rank) FILTER (rank <= 3) AS cases FROM cases WHERE rank <= 5 AND period = 'last_12_months' GROUP BY patient_id)
SELECT patient_id, coalesce(found, 0)::INT AS found, concat_ws(chr(10), 'Patient ID: ' || patient_id, CASE WHEN visits > 0 THEN 'Total Visits: ' || visits END,
  CASE WHEN len(l_conditions) > 0 THEN 'Conditions: ' || array_to_string(l_conditions[1:3], ', ') END, CASE WHEN len(l_medications) > 0 THEN 'Medication History: ' || array_to_string(l_medications[1:3], ', ') END,
  CASE WHEN n > 0 THEN 'Active Treatments: ' || n || ' medications' END, CASE WHEN n > 0 THEN 'Key Medications: ' || key_meds END, cases) AS summary
FROM ov LEFT JOIN tl USING (patient_id) LEFT JOIN found USING (patient_id) WHERE patient_id IN (SELECT conv_id FROM conversations)""")
def h18_summaries(spark, sf):
    """Summary of each asked patient with similar cases of the last year of the table."""
    p, v, e = _graph(spark, sf)
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("patient_id")).distinct()
    lines = H.report_lines(H.patient_overview(p, v, e), H.current_treatments(v, e)).join(asked, "patient_id", "left_semi")
    cases = C.case_lines(_cases(spark, sf, "last_12_months")).withColumnRenamed("query_id", "patient_id")
    return lines.join(cases, "patient_id", "left").select("patient_id", F.coalesce("found", F.lit(0)).alias("found"), F.concat_ws("\n", "summary", "cases").alias("summary"))
