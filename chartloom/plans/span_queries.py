"""Registered extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import spans as S
from chartloom.functions.spans import Rule, spread
from chartloom.operators import spans as E
from chartloom.plans import sqltext as X
from chartloom.plans.notes import SQL_NOTES, notes
from chartloom.plans.questions import SQL_QUESTIONS, questions
from chartloom.plans.registry import query, table

GENERIC_RULES = [
    Rule("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.9),
    Rule("email", r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+", 0.8),
    Rule("phone", r"[0-9]{3}-[0-9]{3,4}(?:-[0-9]{4})?", 0.7),
    Rule("license", r"licen[sc]ed? [^.\n]*", 0.6),
    Rule("number", r"[0-9]+", 0.5),
]


def _rows(docs, *extra):
    return E.to_rows(docs, ["doc_id", *extra])


def _documents(spark, sf):
    return spread(table(spark, sf, "documents"))


@query("e01_pattern_spans", f"WITH {SQL_NOTES}, s AS ({X.find(E.pattern_rules())}) SELECT doc_id, ord, label, start, \"end\", text FROM s")
def e01(spark, sf):
    rows = _rows(E.extract(notes(spark, sf), E.pattern_rules(), E.pattern_score, native=False))
    return rows.select("doc_id", "ord", "label", "start", "end", "text")


@query("e01_document_spans", f"WITH s AS ({X.find(GENERIC_RULES, 'documents')}) SELECT doc_id, ord, label, start, \"end\", text, conf AS confidence FROM s")
def e01_documents(spark, sf):
    rows = _rows(E.extract(_documents(spark, sf), GENERIC_RULES))
    return rows.select("doc_id", "ord", "label", "start", "end", "text", "confidence")


@query("e02_clinical_spans_context", f"""WITH {SQL_NOTES}, s AS ({X.find(E.clinical_rules())})
SELECT doc_id, ord, label, start, "end", s.text, conf AS confidence,
  substr(n.text, greatest(start - 50, 0) + 1, least("end" + 50, length(n.text)) - greatest(start - 50, 0)) AS context
FROM s JOIN notes n USING (doc_id)""")
def e02(spark, sf):
    docs = E.extract(notes(spark, sf).withColumn("doc_text", F.col("text")), E.clinical_rules(), native=False)
    rows = E.with_context(_rows(docs, "doc_text"))
    return rows.select("doc_id", "ord", "label", "start", "end", "text", "confidence", "context")


def _simple(name, rules):
    @query(name, f"WITH {SQL_NOTES}, s AS ({X.find(rules)}) SELECT doc_id, ord, label, kind, start, \"end\", text, conf AS confidence FROM s")
    def run(spark, sf):
        return _rows(E.extract(notes(spark, sf), rules, native=False)).select(
            "doc_id", "ord", "label", F.coalesce("semantic_type", F.lit("")).alias("kind"), "start", "end", "text", "confidence")
    return run


_simple("e03_extra_spans", E.extra_rules())
_simple("e04_temporal_spans", E.temporal_rules())



def _lab_group(g):
    return "CASE ord " + " ".join(
        f"WHEN {i} THEN regexp_extract(text, {X.q('(?i)' + p)}, {g})" for i, p in enumerate(L.LAB_RANGE_PATTERNS)) + " END"


@query("e05_lab_ranges", f"""WITH {SQL_NOTES}, s AS ({X.find(E.lab_rules())}),
g AS (SELECT *, {_lab_group(1)} AS v, {_lab_group(2)} AS lo, {_lab_group(3)} AS hi FROM s)
SELECT doc_id, start, text, nullif(v, '') AS value, CASE WHEN lo <> '' AND hi <> '' THEN lo || '-' || hi END AS reference_range, conf AS confidence FROM g""")
def e05(spark, sf):
    return _rows(E.extract(notes(spark, sf), E.lab_rules(), native=False)).select(
        "doc_id", "start", "text", "value", "reference_range", "confidence")


_SQL_PATTERN_SPANS = f"""found AS (SELECT doc_id, ord, label, start, "end", text,
  {X.score('label', 'text', L.LABEL_CONFIDENCE, L.DEFAULT_CONFIDENCE)} AS conf FROM ({X.find(E.pattern_rules())}))"""
_SQL_RESOLVED = f"WITH {SQL_NOTES}, {_SQL_PATTERN_SPANS}, spans AS ({X.resolve('found')})"


@query("e06_confidence_by_label", f"WITH {SQL_NOTES}, {_SQL_PATTERN_SPANS} SELECT label, round(conf, 6) AS confidence, count(*) AS n FROM found GROUP BY ALL")
def e06(spark, sf):
    rows = _rows(E.extract(notes(spark, sf), E.pattern_rules(), E.pattern_score, native=False))
    return rows.groupBy("label", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("e07_resolved_pattern_spans", f"{_SQL_RESOLVED} SELECT doc_id, start, \"end\", label, text, round(conf, 6) AS confidence FROM spans")
def e07(spark, sf):
    return _rows(E.extract_patterns(notes(spark, sf), native=False)).select(
        "doc_id", "start", "end", "label", "text", F.round("confidence", 6).alias("confidence"))


@query("e08_resolved_document_spans", f"""WITH found AS ({X.find(GENERIC_RULES, 'documents')}), spans AS ({X.resolve('found')})
SELECT doc_id, start, "end", label, text FROM spans""")
def e08(spark, sf):
    docs = E.resolve(E.extract(_documents(spark, sf), GENERIC_RULES))
    return _rows(docs).select("doc_id", "start", "end", "label", "text")


_MIXED = E.clinical_rules() + E.temporal_rules() + E.lab_rules()


@query("e09_merged_clinical_spans", f"""WITH {SQL_NOTES}, found AS ({X.find(_MIXED)}), spans AS ({X.resolve('found')})
SELECT doc_id, start, "end", label, text, conf AS confidence FROM spans""")
def e09(spark, sf):
    return _rows(E.extract_resolved(notes(spark, sf), _MIXED)).select(
        "doc_id", "start", "end", "label", "text", "confidence")


# --- labels and types over the texts of the found spans ----------------------

_SQL_TEXTS = f"texts AS (SELECT label, text, count(*) AS n FROM ({X.find(_MIXED)}) GROUP BY ALL)"


def _texts(spark, sf):
    return E.count_texts(notes(spark, sf), _MIXED)


_MODEL_SOURCES = ["general", "scientific", "drug", "transformer", "biomedical"]
_MODEL_LABELS = ["DISEASE", "DRUG", "LAB", "PERSON", "EVENT", "QUANTITY", "FINDING", "STRENGTH", "NORP"]


def _cases(key, values):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_MODEL_SELECT = (f"doc_id, {_cases('doc_id', _MODEL_SOURCES)} AS source, {_cases('(doc_id + quality)', _MODEL_LABELS)} AS label, "
                 "CAST(doc_id % 100 AS DOUBLE) / 100 AS score")


def _model_spans(spark, sf):
    """Predictions per labelled document: the label row decides source, label and score."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return table(spark, sf, "labels").selectExpr(*_split_select(_MODEL_SELECT)).join(docs, "doc_id")


def _split_select(text):
    parts, depth, cur = [], 0, ""
    for word in text.split(", "):
        cur = f"{cur}, {word}" if cur else word
        depth = cur.count("(") - cur.count(")")
        if depth == 0:
            parts.append(cur)
            cur = ""
    return parts


def _sql_unknown(text, label):
    low = f"lower(trim({text}))"
    groups = {}
    for kind, p in L.UNKNOWN_LABEL_RULES:
        groups.setdefault(kind, []).append(p)
    chain = " ".join(f"WHEN {X.any_pattern(low, ps)} THEN {X.q(k)}" for k, ps in groups.items())
    digit = f"regexp_matches({low}, '[0-9]')"
    return (f"CASE {chain} WHEN {label} IN ('MISC', 'PRODUCT', 'WORK_OF_ART') THEN CASE WHEN "
            f"{X.contains_any(low, ['test', 'panel', 'profile', 'study'])} THEN 'LAB_TEST' ELSE 'CONDITION' END "
            f"WHEN {label} IN ('NORP', 'LANGUAGE') THEN 'CONDITION' WHEN {label} IN ('QUANTITY', 'CARDINAL') THEN "
            f"CASE WHEN {digit} THEN 'LAB_VALUE' ELSE 'CONDITION' END "
            f"WHEN {digit} AND {X.contains_any(low, ['mg', 'dl', 'mmol', '%', 'count', 'level'])} THEN 'LAB_VALUE' "
            f"WHEN {X.contains_any(low, ['patient', 'hospital', 'clinic', 'lab'])} THEN 'ORGANIZATION' ELSE 'CONDITION' END")


_SQL_MODEL = f"""model AS (SELECT {_MODEL_SELECT}, text FROM labels JOIN documents USING (doc_id)),
mapped AS (SELECT doc_id, source, label AS semantic_type,
  coalesce({X.lookup("source || '|' || label", {f'{s}|{k}': v for s, (_, _, t) in L.MODEL_LABELS.items() for k, v in t.items()})},
           {X.lookup('source', {s: d for s, (d, _, _) in L.MODEL_LABELS.items() if d})}, {_sql_unknown('text', 'label')}) AS label,
  coalesce(CASE source {' '.join(f"WHEN '{s}' THEN {c}::DOUBLE" for s, (_, c, _) in L.MODEL_LABELS.items() if c)} END, score) AS confidence FROM model)"""


@query("e11_model_labels", f"WITH {_SQL_MODEL} SELECT * FROM mapped")
def e11(spark, sf):
    return E.map_model_labels(_model_spans(spark, sf)).select("doc_id", "source", "semantic_type", "label", "confidence")


@query("e12_unknown_labels", f"WITH {SQL_NOTES}, {_SQL_TEXTS} SELECT label, text, n, {_sql_unknown('text', 'label')} AS type FROM texts")
def e12(spark, sf):
    return _texts(spark, sf).withColumn("type", F.expr(E.classify_unknown_sql("text", "label")))


_ARTIFACT_WORDS = ", ".join(X.q(w) for w in dict.fromkeys(L.GENERIC_HEADINGS + L.ADMIN_TERMS + L.OCR_ARTIFACTS))
_SQL_WORDS = """words AS (SELECT w AS text, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM notes
  UNION ALL SELECT unnest(string_split(text, '. ')) FROM notes) GROUP BY w)"""


def _words(spark, sf):
    n = notes(spark, sf)
    tokens = n.select(F.explode(F.split("text", "[ \\n]+")).alias("text"))
    sentences = n.select(F.explode(F.split("text", "\\. ")).alias("text"))
    return tokens.unionAll(sentences).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("e13_artifacts", f"""WITH {SQL_NOTES}, {_SQL_WORDS}, l AS (SELECT *, lower(trim(text)) AS low FROM words)
SELECT text, n, length(low) <= 1 OR {X.any_pattern('low', L.TEXT_ARTIFACT_PATTERNS)} AS text_artifact,
  low IN ({_ARTIFACT_WORDS}) OR length(low) < 2 OR {X.any_pattern('low', L.ENTITY_ARTIFACT_PATTERNS)}
  OR (NOT regexp_matches(low, '\\s') AND length(low) > 15 AND NOT regexp_matches(low, '^\\pL+$')) AS entity_artifact FROM l""")
def e13(spark, sf):
    return _words(spark, sf).select("text", "n", F.expr(E.text_artifact_sql("text")).alias("text_artifact"),
                                    F.expr(E.entity_artifact_sql("text")).alias("entity_artifact"))


def _sql_ocr(text):
    """The corrections without look-ahead: the next sign is captured and put back, the end is a step of its own."""
    table_, gates = {}, {"digit": f"regexp_matches({text}, '[0-9]')", "letters": f"regexp_matches({text}, '[a-zA-Z]{{3,}}')"}
    for wrong, right in L.OCR_CORRECTIONS.items():
        table_.setdefault(wrong.lower(), right)
    fixed = text
    for gate, pattern, replacement in L.OCR_STEPS:
        if "(?=" in pattern:
            head, ahead = pattern[:-1].split("(?=")
            signs = "|".join(x for x in ahead.split("|") if x != "$")
            step = f"regexp_replace({fixed}, '{head}({signs})', '{replacement}\\1', 'g')"
            if "$" in ahead.split("|"):
                step = f"regexp_replace({step}, '{head}$', '{replacement}')"
        else:
            step = f"regexp_replace({fixed}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
        fixed = f"CASE WHEN {gates[gate]} THEN {step} ELSE {fixed} END" if gate else step
    return f"coalesce({X.lookup(f'lower({text})', table_)}, {fixed})"


@query("e14_ocr_corrections", f"""WITH {SQL_NOTES}, {_SQL_WORDS},
al AS (SELECT text FROM words UNION ALL SELECT unnest(string_split_regex(text, '\\s+')) FROM documents)
SELECT text, count(*) AS n, {_sql_ocr('text')} AS corrected FROM al GROUP BY text""")
def e14(spark, sf):
    """Corrections of the words of all documents and notes."""
    words = _documents(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("text"))
    both = words.unionAll(_words(spark, sf).select("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("corrected", F.expr(E.ocr_fix_sql("text")))


def _sql_type(text, label):
    low = f"lower(trim({text}))"
    result = {"ID": "PERSON", "LAB_VALUE_2": "LAB_VALUE"}
    chain = " ".join(f"WHEN {X.any_pattern(low, ps)} THEN {X.q(result.get(k, k))}" for k, ps in L.TYPE_RULES.items())
    drug = X.any_pattern(low, L.MEDICATION_EVIDENCE + ["(?:" + "|".join(L.MEDICATION_SUFFIXES) + ")$"])
    return (f"CASE {chain} WHEN {label} = 'MEDICATION' AND NOT {drug} THEN 'ORGANIZATION' WHEN {label} = 'CONDITION' "
            f"AND NOT {X.any_pattern(low, L.CONDITION_EVIDENCE)} THEN 'ORGANIZATION' ELSE {label} END")


@query("e15_validated_types", f"WITH {SQL_NOTES}, {_SQL_TEXTS} SELECT label, text, n, {_sql_type('text', 'label')} AS type FROM texts")
def e15(spark, sf):
    return _texts(spark, sf).withColumn("type", F.expr(E.validated_type_sql("text", "label")))


def _sql_normal(fold):
    t = {}
    for group, terms in L.TERMS.items():
        for term, normal in terms.items():
            t.setdefault(f"{group}|{term.lower() if fold else term}", normal)
    return f"coalesce({X.lookup(X.lookup('label', L.TERM_GROUP) + ' || ' + chr(39) + '|' + chr(39) + ' || lower(trim(text))', t)}, text)"


@query("e16_normalized_terms", f"""WITH {SQL_NOTES}, {_SQL_TEXTS} SELECT label, text, n, {_sql_normal(False)} AS normalized_text,
  {_sql_normal(True)} AS folded_text FROM texts""")
def e16(spark, sf):
    return E.normalize_terms(_texts(spark, sf)).withColumn(
        "folded_text", F.expr(E.normal_form_sql("text", "label", True)))


_CODES = {f"{s}|{k}": v for s, t in L.CODES.items() for k, v in t.items()}


@query("e17_concept_links", f"""WITH {SQL_NOTES}, {_SQL_TEXTS},
c AS (SELECT *, {X.lookup('label', L.CODE_SYSTEM)} AS system FROM texts),
d AS (SELECT *, {X.lookup("system || '|' || lower(text)", _CODES)} AS concept_code FROM c)
SELECT label, text, n, concept_code, CASE WHEN concept_code IS NOT NULL THEN system || ':' || concept_code END AS entity_id FROM d""")
def e17(spark, sf):
    return E.link_concepts(_texts(spark, sf))


@query("e18_related_events", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS start FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS pos FROM e)
SELECT a.user_id, a.event_id, string_agg(b.pos, ',' ORDER BY b.pos) AS related FROM p a JOIN p b
ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.start - b.start) <= 20000
WHERE (a.event_type, b.event_type) IN (('click', 'purchase'), ('purchase', 'click'), ('view', 'error'), ('error', 'view'))
GROUP BY ALL""")
def e18(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type",
        F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1000000).alias("start"))
    out = E.related_rows(rows, "user_id", "start", "event_type", "event_id",
                         [("click", "purchase"), ("view", "error")], 20000, F.floor(F.col("start") / 86400))
    return out.select("user_id", "event_id", F.array_join("related", ",").alias("related"))


_SQL_TYPED = f"{_SQL_RESOLVED}"


@query("e19_type_filter", f"{_SQL_TYPED} SELECT label, count(*) AS n FROM spans WHERE label IN ('date', 'vitals') GROUP BY label")
def e19(spark, sf):
    rows = _rows(E.extract_patterns(notes(spark, sf), native=False))
    kept = E.filter_types(rows, include=["date", "vitals", "symptoms"], exclude=["symptoms"])
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("e20_top_spans", """
SELECT doc_id, position, confidence FROM (SELECT l_orderkey AS doc_id, l_partkey AS position, l_discount + 0.0 AS confidence,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount + 0.0 DESC, l_shipdate, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3""")
def e20(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("position"),
        (F.col("l_discount") + F.lit(0.0)).alias("confidence"), "l_shipdate", "l_suppkey")
    return E.top_spans(rows, "doc_id", 3, ["l_shipdate", "position", "l_suppkey"]).select("doc_id", "position", "confidence")


@query("e21_confident_spans", f"{_SQL_TYPED} SELECT doc_id, count(*) AS n FROM spans WHERE conf >= 0.9 GROUP BY doc_id")
def e21(spark, sf):
    rows = E.confident(_rows(E.extract_patterns(notes(spark, sf), native=False)), 0.9)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("e22_groups", """
SELECT l_orderkey AS doc_id, l_returnflag AS label, count(*) AS n, round(avg(l_discount + 0.0), 6) AS avg_confidence,
  count(DISTINCT lower(l_linestatus)) AS unique_values FROM lineitem GROUP BY ALL""")
def e22(spark, sf):
    g = E.group_by_type(_line_spans(spark, sf), ["doc_id"])
    return g.withColumn("avg_confidence", F.round("avg_confidence", 6))


def _line_spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("text"),
        (F.col("l_discount") + F.lit(0.0)).alias("confidence"))


@query("e23_type_scores", """
WITH g AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, avg(l_discount + 0.0) AS a FROM lineitem GROUP BY ALL)
SELECT doc_id, string_agg(label || '=' || round(a * 1000000, 0)::BIGINT, ',' ORDER BY label) AS scores, round(avg(a), 6) AS overall_confidence FROM g GROUP BY doc_id""")
def e23(spark, sf):
    out = E.type_scores(E.group_by_type(_line_spans(spark, sf), ["doc_id"]), ["doc_id"])
    shown = F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat_ws(
        "=", e["key"], F.round(e["value"] * 1000000, 0).cast("bigint").cast("string")))
    return out.select("doc_id", F.array_join(shown, ",").alias("scores"), F.round("overall_confidence", 6).alias("overall_confidence"))


_REPEATS = "|".join(("\\" + chr(c) if c < 128 and not chr(c).isalnum() else chr(c)) + "{4}" for c in [*range(32, 127), *range(192, 256)])


@query("e24_text_quality", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n, lower(text) AS low FROM documents),
r AS (SELECT *, (n - length(regexp_replace(text, '[^\\pL\\pM\\pN\\p{{Pc}}\\s.,;:!?-]', '', 'g'))) / n::DOUBLE AS ratio FROM d)
SELECT doc_id, round(least(1.0::DOUBLE, CASE WHEN n < 10 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN ratio > 0.1 THEN 1 - ratio ELSE 1 END
  * CASE WHEN regexp_matches(text, {X.q(_REPEATS)}) THEN 0.8::DOUBLE ELSE 1 END
  * (1 + 0.1::DOUBLE * ({' + '.join(f"contains(low, '{t}')::INT" for t in L.QUALITY_TERMS)}))), 6) AS quality FROM r""")
def e24(spark, sf):
    return _documents(spark, sf).select("doc_id", F.round(E.text_quality(F.col("text")), 6).alias("quality"))


_SQL_DOC_STATS = """stats AS (SELECT n.doc_id, length(n.text) AS text_length,
  len(list_filter(string_split_regex(n.text, '\\s+'), lambda t: t <> '')) AS tokens,
  count(s.conf) AS entities_found, coalesce(avg(s.conf), 0) AS mean FROM notes n LEFT JOIN spans s USING (doc_id) GROUP BY n.doc_id, n.text)"""


def _stats(spark, sf):
    docs = E.extract_patterns(notes(spark, sf), native=False).withColumnRenamed("spans", "entities")
    return E.document_report(docs, "doc_id")


@query("e25_next_steps", f"""{_SQL_RESOLVED}, {_SQL_DOC_STATS}
SELECT doc_id, CASE WHEN entities_found = 0 THEN 'Consider text preprocessing or different extraction models'
  WHEN entities_found < 5 THEN 'Ready for timeline structuring and relationship analysis'
  ELSE 'Ready for knowledge graph construction and entity linking' END AS next_step,
  concat_ws('|', CASE WHEN entities_found = 0 THEN 'Consider adjusting confidence threshold or processing mode' END,
    CASE WHEN entities_found > 100 THEN 'Consider text chunking for better performance' END,
    CASE WHEN mean < 0.7 THEN 'Consider using higher accuracy processing mode' END) AS recommendations FROM stats""")
def e25(spark, sf):
    return _stats(spark, sf).select("doc_id", "next_step", F.array_join("recommendations", "|").alias("recommendations"))


@query("e26_document_metrics", f"""{_SQL_RESOLVED}, {_SQL_DOC_STATS}
SELECT doc_id, text_length, tokens, entities_found, round(mean, 6) AS avg_confidence FROM stats""")
def e26(spark, sf):
    return _stats(spark, sf).select("doc_id", "text_length", "tokens", "entities_found",
                                    F.round("avg_confidence", 6).alias("avg_confidence"))


@query("e27_batch_report", f"""{_SQL_RESOLVED},
g AS (SELECT doc_id, label, avg(conf) AS a FROM spans GROUP BY ALL), o AS (SELECT doc_id, avg(a) AS overall FROM g GROUP BY doc_id)
SELECT patient_id, count(*) AS total_documents, count(*) AS successful, 0::BIGINT AS failed,
  round(avg(coalesce(overall, 0)) + 1e-12, 9) AS batch_confidence FROM notes LEFT JOIN o USING (doc_id) GROUP BY patient_id""")
def e27(spark, sf):
    docs = E.extract_patterns(notes(spark, sf), native=False).withColumnRenamed("spans", "entities")
    reports = E.document_report(docs, "doc_id").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient_id")), "doc_id")
    return E.batch_report(reports, ["patient_id"]).withColumn("batch_confidence", F.round(F.col("batch_confidence") + 1e-12, 9))


@query("e28_validation", f"""WITH {_SQL_MODEL} SELECT source, count(*) AS total_validated, count(*) FILTER (confidence >= 0.8) AS valid,
  count(*) FILTER (confidence < 0.8) AS invalid, round(avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS validation_score
FROM mapped GROUP BY source""")
def e28(spark, sf):
    rows = E.map_model_labels(_model_spans(spark, sf))
    return E.validate(rows, ["source"]).withColumn("validation_score", F.round("validation_score", 6))


@query("e29_text_windows", """
SELECT doc_id, start, substr(text, start + 1, 512) AS "window" FROM (
  SELECT doc_id, text, unnest(generate_series(0, (ceil(greatest(length(text) - 512, 0) / 128.0) * 128)::INT, 128))::INT AS start
  FROM documents WHERE length(text) > 0)""")
def e29(spark, sf):
    return E.text_windows(_documents(spark, sf), "doc_id")


@query("e30_entities")
def e30(spark, sf):
    """The whole extraction over all notes (look-ahead rules, no SQL twin)."""
    docs = E.extract_entities(notes(spark, sf))
    rows = docs.select("doc_id", F.posexplode_outer("entities").alias("position", "e")).filter(F.col("e").isNotNull())
    return rows.select("doc_id", "position", "e.*").withColumn("related", F.array_join("related", ","))


@query("e31_question_entities", f"""WITH {SQL_QUESTIONS}, l AS (SELECT *, lower(query) AS low FROM questions)
SELECT conv_id, turn, array_to_string(regexp_extract_all(low, 'patient[_\\s]*(\\d+|[a-z]+\\d+)', 1), ',') AS patients,
  array_to_string(list_filter([{', '.join(X.q(w) for w in L.QUERY_CONDITIONS)}], lambda w: contains(low, w)), ',') AS conditions,
  array_to_string(list_filter([{', '.join(X.q(w) for w in L.QUERY_MEDICATIONS)}], lambda w: contains(low, w)), ',') AS medications FROM l""")
def e31(spark, sf):
    from chartloom.operators.retrieval import question_entities
    q = question_entities(questions(spark, sf))
    return q.select("conv_id", "turn", *[F.array_join(F.element_at("entities", k), ",").alias(k)
                                         for k in ("patients", "conditions", "medications")])


_HYBRID = [Rule("DISEASE", r"\b(?:pain|fatigue|nausea|severe \w+)\b", 0.9), Rule("ORG", r"\b\w+ (?:clinic|hospital|laboratory)\b", 0.9),
           Rule("QUANTITY", r"\b\d+\.\d+\b", 0.9), Rule("UNMAPPED", r"\bplan\b", 0.9)]


@query("e32_hybrid_spans", f"""WITH {SQL_NOTES}, {_SQL_PATTERN_SPANS}, first AS ({X.resolve('found')}),
model AS (SELECT doc_id, ord, {X.lookup('label', L.HYBRID_LABELS)} AS label, start, "end", text, conf FROM ({X.find(_HYBRID, first_ord=500)}) WHERE label <> 'UNMAPPED'),
united AS (SELECT doc_id, ord, label, start, "end", text, conf FROM first UNION ALL SELECT doc_id, ord, label, start, "end", text, conf FROM model),
spans AS ({X.resolve('united')}) SELECT doc_id, start, "end", label, text, round(conf, 6) AS confidence FROM spans""")
def e32(spark, sf):
    """Pattern spans, then model spans beside them (here stand-in rules), resolved together."""
    docs = E.extract_patterns(notes(spark, sf), native=False)
    model = [Rule(L.HYBRID_LABELS[r.label], r.pattern, r.confidence) for r in _HYBRID if r.label in L.HYBRID_LABELS]
    both = E.extract(docs, model, first_ord=500, into="model", native=False).withColumn("spans", F.concat("spans", "model"))
    return _rows(E.resolve(both)).select("doc_id", "start", "end", "label", "text", F.round("confidence", 6).alias("confidence"))


@query("e33_stored_entities", """
SELECT doc_id, string_agg(label || '=' || n, ',' ORDER BY label) AS counts, sum(n)::BIGINT AS total, round(sum(c) / sum(n), 6) AS avg_confidence
FROM (SELECT l_orderkey AS doc_id, l_returnflag AS label, count(*) AS n, sum(l_discount + 0.0) AS c FROM lineitem GROUP BY ALL) GROUP BY doc_id""")
def e33(spark, sf):
    out = E.stored_entities(_line_spans(spark, sf), "doc_id")
    shown = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("doc_id", F.array_join(shown, ",").alias("counts"), "total", F.round("avg_confidence", 6).alias("avg_confidence"))
