"""DuckDB SQL for the queries: written from the operators' definitions, not from their plans."""

from __future__ import annotations

from caseframe.schema import METRICS

LANGS = "['en', 'de', 'ar_msa', 'fr', 'es', 'hi', 'sw']"
UNITS = "['hours', 'days', 'weeks']"
#: Language of a numbered row.
LANGUAGE = LANGS + "[({} % 7 + 1)::INT]"

CASES = f"""
lines AS (
  SELECT l_orderkey AS case_id, 'sym_' || (l_partkey % 23) AS name,
    CASE l_returnflag WHEN 'N' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'uncertain' END AS status,
    CASE WHEN l_returnflag = 'N' THEN (l_quantity::INT % 12 + 1) END AS value,
    CASE WHEN l_returnflag = 'N' THEN {UNITS}[(l_linenumber % 3 + 1)::INT] END AS unit,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
heads AS (
  SELECT o_orderkey AS case_id, o_orderpriority AS case_pattern,
    CASE o_orderstatus WHEN 'F' THEN 'reported' WHEN 'O' THEN 'none' ELSE 'unknown' END AS med,
    ['unknown', 'none', 'reported'][(o_orderkey % 3 + 1)::INT] AS alg,
    (SELECT NULL) AS dummy FROM orders),
cases AS (
  SELECT h.case_id, h.case_pattern, h.med, h.alg, f.name AS chief, f.value IS NULL AS no_duration, f.status AS chief_status, n.n, n.names
  FROM heads h JOIN lines f ON f.case_id = h.case_id AND f.pos = 1
  JOIN (SELECT case_id, count(*) AS n, list(name) AS names FROM lines GROUP BY case_id) n ON n.case_id = h.case_id)
"""


def predicted(shift: int, name: str) -> str:
    """Entries of the predictions (kinds 8 and 9 have none that count)."""
    return f"""
{name}_kind AS (SELECT *, ((case_id * 7 + case_id // 11 + {shift}) % 10)::INT AS k FROM cases),
{name}_lines AS (
  SELECT l.case_id, l.pos, l.name,
    CASE WHEN k = 5 AND pos = 1 THEN CASE WHEN status = 'absent' THEN 'uncertain' ELSE 'absent' END ELSE status END AS status,
    CASE WHEN k = 5 AND pos = 1 THEN NULL WHEN k = 6 AND pos = 1 THEN value + 1 ELSE value END AS value,
    CASE WHEN k = 5 AND pos = 1 THEN NULL ELSE unit END AS unit
  FROM lines l JOIN {name}_kind USING (case_id) WHERE NOT (k = 3 AND pos = n)
  UNION ALL SELECT case_id, n + 1, 'sym_extra', 'absent', NULL, NULL FROM {name}_kind WHERE k = 4),
{name}_last AS (
  SELECT case_id, list(name || '/' || status ORDER BY name) AS last_statuses, list(name || '/' || d ORDER BY name) AS last_durations FROM (
    SELECT case_id, name, arg_max(status, pos) AS status, arg_max(coalesce(value || unit, '-'), pos) AS d FROM {name}_lines GROUP BY case_id, name) GROUP BY case_id),
{name}_map AS (
  SELECT case_id, count(*) = count(DISTINCT name) AS single, list(name ORDER BY name) AS names,
    list(name || '/' || status || '/' || coalesce(value || unit, '-') ORDER BY name || '/' || status || '/' || coalesce(value || unit, '-')) AS entries,
    list(name || '/' || status ORDER BY name, status) AS statuses,
    list(name || '/' || coalesce(value || unit, '-') ORDER BY name, coalesce(value || unit, '-')) AS durations
  FROM {name}_lines GROUP BY case_id),
{name}_chief AS (
  SELECT l.case_id, arg_min(value, pos) FILTER (value IS NOT NULL) AS any_value, min_by((pos, value), pos) AS first
  FROM {name}_lines l JOIN cases c ON c.case_id = l.case_id AND c.chief = l.name GROUP BY l.case_id)"""


TRUTH = """
true_last AS (
  SELECT case_id, list(name || '/' || status ORDER BY name) AS last_statuses, list(name || '/' || d ORDER BY name) AS last_durations FROM (
    SELECT case_id, name, arg_max(status, pos) AS status, arg_max(coalesce(value || unit, '-'), pos) AS d FROM lines GROUP BY case_id, name) GROUP BY case_id),
true_map AS (
  SELECT case_id, count(*) = count(DISTINCT name) AS single, list(name ORDER BY name) AS names,
    list(name || '/' || status || '/' || coalesce(value || unit, '-') ORDER BY name || '/' || status || '/' || coalesce(value || unit, '-')) AS entries,
    list(name || '/' || status ORDER BY name, status) AS statuses,
    list(name || '/' || coalesce(value || unit, '-') ORDER BY name, coalesce(value || unit, '-')) AS durations
  FROM lines GROUP BY case_id)"""


def scored(shift: int, name: str, dialect: str = "e2") -> str:
    """The metrics of each case; a repeated name voids the map (e2), or fails the comparison (e3)."""
    lenient = dialect in ("e1", "e3")
    valid = "k <> 9" if lenient else "k NOT IN (8, 9)"
    if dialect == "e2":
        same = lambda c: f"(CASE WHEN p.single THEN p.{c} ELSE [] END) = (CASE WHEN t.single THEN t.{c} ELSE [] END)"
        extraction, status, duration = same("names"), same("statuses"), same("durations")
    elif dialect == "e3":
        both = "coalesce(p.single, true) AND t.single AND "
        extraction = "coalesce(p.names, []) = t.names"
        status, duration = both + "coalesce(p.statuses, []) = t.statuses", both + "coalesce(p.durations, []) = t.durations"
    else:
        extraction = "list_sort(list_distinct(coalesce(p.names, []))) = list_sort(list_distinct(t.names))"
        status, duration = ("coalesce(pl.last_{0}, []) = tl.last_{0}".format(c) for c in ("statuses", "durations"))
    if dialect == "e2":
        extraction, status, duration = (x.replace("CASE WHEN p.single THEN", "CASE WHEN coalesce(p.single, false) THEN") for x in (extraction, status, duration))
    core = "extraction AND status AND duration" if dialect == "e2" else "entries"
    return f"""
{name}_fields AS (
  SELECT c.case_id, {LANGUAGE.format("c.case_id")} AS language, {valid} AS valid,
    {extraction} AS extraction, {status} AS status, {duration} AS duration, coalesce(p.entries, []) = t.entries AS entries,
    (ch.first IS NULL OR ch.first[2] IS NULL) = c.no_duration AS derived
  FROM {name}_kind c JOIN true_map t USING (case_id) JOIN true_last tl USING (case_id) LEFT JOIN {name}_map p USING (case_id) LEFT JOIN {name}_last pl USING (case_id) LEFT JOIN {name}_chief ch USING (case_id)),
{name} AS (
  SELECT case_id, language, valid AS valid_json, valid AS schema_valid, valid AND {core} AS raw_exact,
    valid AND {core} AS core_exact, valid AND {core} AND derived AS pipeline_exact,
    valid AS chief_complaint, valid AND extraction AS symptom_extraction, valid AND status AS symptom_status, valid AND duration AS duration,
    valid AS medication, valid AS allergy, valid AS missing_information_raw, valid AND derived AS missing_information_derived
  FROM {name}_fields)"""


METRIC_LIST = ", ".join(METRICS)
COUNTS = ", ".join(f"count(*) FILTER ({m}) AS {m}" for m in METRICS)


def with_scores(body: str, both: bool = False, dialect: str = "e2") -> str:
    parts = [CASES, TRUTH, predicted(0, "base"), scored(0, "base", dialect)]
    if both:
        parts += [predicted(3, "cand"), scored(3, "cand", dialect)]
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + body


def counted(scope: str, metrics: tuple[str, ...] = METRICS, scale: str = "") -> str:
    names = ", ".join(metrics)
    return f"""
, counts AS (SELECT {scope} AS scope, count(*) AS total, {COUNTS} FROM base GROUP BY ALL),
long AS (UNPIVOT (SELECT scope, total, {names} FROM counts) ON {names} INTO NAME metric VALUE correct)
SELECT {{}} metric, correct, total, {scale}correct / total AS accuracy FROM long"""


OUTCOMES = """
, pairs AS (UNPIVOT (SELECT b.case_id, b.language, {b} FROM base b JOIN cand c USING (case_id, language)) ON {m} INTO NAME metric VALUE category),
counts AS (
  SELECT {by} metric, count(*) AS total, count(*) FILTER (category = 3) AS both_correct, count(*) FILTER (category = 1) AS improved,
    count(*) FILTER (category = 2) AS regressed, count(*) FILTER (category = 0) AS both_wrong FROM pairs GROUP BY ALL)
SELECT {by} metric, total, both_correct, improved, regressed, both_wrong, {more}
  100.0 * (both_correct + regressed) / total AS base_accuracy, 100.0 * (both_correct + improved) / total AS candidate_accuracy,
  100.0 * (both_correct + improved) / total - 100.0 * (both_correct + regressed) / total AS delta FROM counts
"""
PAIR_COLUMNS = ", ".join(f"(2 * b.{m}::INT + c.{m}::INT) AS {m}" for m in METRICS)

#: Failures of each record in the base predictions: one row for each occurrence.
FAILED = """
, t1 AS (SELECT case_id, name, arg_min(status, pos) AS status, arg_min(coalesce(value || unit, '-'), pos) AS duration FROM lines GROUP BY ALL),
p1 AS (SELECT l.case_id, name, arg_min(status, pos) AS status, arg_min(coalesce(value || unit, '-'), pos) AS duration, count(*) AS copies
  FROM base_lines l JOIN base_kind k USING (case_id) WHERE k.k NOT IN (8, 9) GROUP BY ALL),
failed AS (
  SELECT case_id, 'invalid_json' AS type, NULL AS symptom, NULL AS expected, NULL AS predicted, 1 AS count FROM base_kind WHERE k IN (8, 9)
  UNION ALL SELECT t.case_id, 'missing_symptom', t.name, NULL, NULL, 1 FROM t1 t JOIN base_kind k ON k.case_id = t.case_id AND k NOT IN (8, 9)
    WHERE NOT EXISTS (SELECT 1 FROM p1 p WHERE p.case_id = t.case_id AND p.name = t.name)
  UNION ALL SELECT p.case_id, 'extra_symptom', p.name, NULL, NULL, 1 FROM p1 p WHERE NOT EXISTS (SELECT 1 FROM t1 t WHERE p.case_id = t.case_id AND p.name = t.name)
  UNION ALL SELECT case_id, 'duplicate_symptom', name, NULL, NULL, copies FROM p1 WHERE copies > 1
  UNION ALL SELECT p.case_id, 'wrong_symptom_status', p.name, t.status, p.status, 1 FROM p1 p JOIN t1 t USING (case_id, name) WHERE p.status <> t.status
  UNION ALL SELECT p.case_id, 'wrong_duration', p.name, t.duration, p.duration, 1 FROM p1 p JOIN t1 t USING (case_id, name) WHERE p.duration <> t.duration)
"""

RESULTS = "results AS (SELECT user_id AS case_id, event_type AS language, max(value) > 60 AS correct FROM events GROUP BY ALL)"
FAILING = f"WITH {RESULTS}, bad AS (SELECT case_id, list(language ORDER BY language) AS languages, count(*) AS n FROM results WHERE NOT correct GROUP BY case_id)"
CLASSES = f"""WITH {RESULTS}, classes AS (
  SELECT case_id, CASE WHEN bool_and(correct) THEN 'all_correct' WHEN NOT bool_or(correct) THEN 'all_failed' ELSE 'mixed' END AS class,
    CASE count(*) FILTER (NOT correct) WHEN 0 THEN NULL WHEN 1 THEN 'only_' || min(language) FILTER (NOT correct)
      ELSE string_agg(language, '+' ORDER BY language) FILTER (NOT correct) END AS signature
  FROM results GROUP BY case_id)"""
SPLIT = """WITH ranked AS (
  SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents),
parts AS (SELECT doc_id, lang, CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train' WHEN r <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""
JUDGED = "WITH judged AS (SELECT d.doc_id AS case_id, d.lang AS language, quality = 1 AS s, toxic = 0 AS k FROM documents d LEFT JOIN labels l USING (doc_id))"
COVER = """
, s AS (SELECT case_id, count(*) AS n, bool_or(status = 'absent') AS a, bool_or(status = 'uncertain') AS u, count(value) AS d FROM lines GROUP BY case_id)
"""
TOKENS = r"""WITH tokens AS (
  SELECT {by}, list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT contains(x, '_')) AS w,
    regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS t FROM documents)"""
LEXICAL = (
    TOKENS
    + """, whole AS (SELECT {by}, count(*) AS utterances, count(DISTINCT t) AS distinct_utterances FROM tokens GROUP BY ALL),
counts AS (SELECT {by}, w, count(*) AS n FROM (SELECT {by}, unnest(w) AS w FROM tokens) GROUP BY ALL),
totals AS (SELECT {by}, sum(n)::BIGINT AS tokens, count(*) AS vocabulary FROM counts GROUP BY ALL),
entropy AS (SELECT {by}, -sum((n / tokens) * ln(n / tokens)) / ln(any_value(vocabulary)) AS e FROM counts JOIN totals USING ({by}) GROUP BY ALL)
SELECT {by}, utterances, distinct_utterances, coalesce(tokens, 0) AS tokens, coalesce(vocabulary, 0) AS vocabulary, round(distinct_utterances / utterances, 8) AS unique_ratio,
  round(coalesce(vocabulary / tokens, 0), 8) AS type_token_ratio, round(CASE WHEN coalesce(vocabulary, 0) <= 1 THEN 0 ELSE e END, 8) AS normalized_entropy
FROM whole LEFT JOIN totals USING ({by}) LEFT JOIN entropy USING ({by})"""
)


def top(n: int, k: int) -> str:
    window = "w[i]" if n == 1 else f"array_to_string(w[i:i + {n - 1}], ' ')"
    return (
        TOKENS.format(by="lang")
        + f""", terms AS (SELECT lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {window})) AS term FROM tokens WHERE len(w) >= {n}),
counts AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY ALL)
SELECT lang, term, total, row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) AS rank FROM counts QUALIFY rank <= {k}"""
    )


WORDS = r"len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
AUDITED = f"""WITH n AS (SELECT doc_id, lang, {WORDS} AS full_tokens FROM documents),
m AS (SELECT *, least(full_tokens, 40) AS prompt FROM n),
a AS (SELECT *, full_tokens > 512 AS truncated, greatest(0, full_tokens - 512) AS tokens_lost, full_tokens - prompt AS assistant, greatest(0, full_tokens - 512) AS lost FROM m)"""

HASHED = "sha256(o_orderkey::VARCHAR)"
DURATION = f"""WITH h AS (SELECT o_orderkey, ('0x' || substr({HASHED}, 1, 2))::INT AS a, ('0x' || substr({HASHED}, 3, 2))::INT AS b FROM orders),
d AS (SELECT o_orderkey, {UNITS}[a % 3 + 1] AS unit, b % [12, 7, 3][a % 3 + 1] + 1 AS value FROM h)
SELECT o_orderkey, value, unit, value || ' ' || unit AS label FROM d"""

ORACLE: dict[str, str] = {
    "status_labels": "WITH " + CASES.strip().rstrip(",") + """, shown AS (
  SELECT 'symptom' AS kind, CASE status WHEN 'present' THEN 'Present' WHEN 'absent' THEN 'Absent' ELSE 'Uncertain' END AS label FROM lines
  UNION ALL SELECT 'medications', CASE med WHEN 'unknown' THEN 'Not reported' WHEN 'none' THEN 'None reported' ELSE 'Reported' END FROM cases
  UNION ALL SELECT 'allergies', CASE alg WHEN 'unknown' THEN 'Not reported' WHEN 'none' THEN 'None reported' ELSE 'Reported' END FROM cases
  UNION ALL SELECT 'missing', 'symptom duration' FROM cases WHERE no_duration UNION ALL SELECT 'missing', 'current medications' FROM cases WHERE med = 'unknown'
  UNION ALL SELECT 'missing', 'allergies' FROM cases WHERE alg = 'unknown') SELECT kind, label, count(*) AS total FROM shown GROUP BY ALL""",
    "model_names": """SELECT p_partkey, replace(replace(replace(lower(trim(' ' || p_name || '+' || p_brand || '/' || p_type)), ' ', '_'), '+', 'plus'), '/', '_') AS name FROM part""",
    "positional_check": "SELECT o_orderkey AS ordinal FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 101 = 0",
    "judge_prompts": """SELECT doc_id, md5(concat('Case: ', source, chr(10), 'Language: ', lang, chr(10), 'Statement: ', text, chr(10),
  'Does the statement say exactly what the case says, in this language? Answer with semantic_passed, language_passed, semantic_errors and language_errors as JSON.')) AS prompt_md5 FROM documents""",
    "failed_first": f"WITH {RESULTS} SELECT language, case_id FROM results WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY language ORDER BY case_id) <= 20",
    "truncated_samples": AUDITED + " SELECT doc_id, least(assistant, greatest(0, 512 - prompt)) < assistant AS target_truncated FROM a WHERE truncated",
    "sorted_json": "SELECT event_id, json(props)::VARCHAR AS json FROM events",
    "eval_metrics_overall": with_scores(counted("'ALL'").format("")),
    "eval_metrics_by_language": with_scores(
        f"""
, counts AS (SELECT CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE language END AS scope, count(*) AS total, {COUNTS} FROM base GROUP BY GROUPING SETS ((), (language))),
long AS (UNPIVOT counts ON {METRIC_LIST} INTO NAME metric VALUE correct)
SELECT scope, metric, correct, total, correct / total AS accuracy FROM long"""
    ),
    "eval_failure_counts": with_scores(
        f"""
, counts AS (SELECT CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE language END AS scope, count(*) AS total, {COUNTS} FROM base GROUP BY GROUPING SETS ((), (language))),
long AS (UNPIVOT counts ON {METRIC_LIST} INTO NAME metric VALUE correct)
SELECT scope, metric, total - correct AS failed FROM long"""
    ),
    "eval_samples": with_scores(f" SELECT case_id, language, {METRIC_LIST} FROM base"),
    "eval_metrics_e1": with_scores(counted("'ALL'", scale="100.0 * ").format(""), dialect="e1"),
    "eval_metrics_e3": with_scores(counted("'ALL'", scale="100.0 * ").format(""), dialect="e3"),
    "compare_categories": with_scores(
        OUTCOMES.format(b=PAIR_COLUMNS, m=METRIC_LIST, by="", more="both_correct + regressed AS base_correct, both_correct + improved AS candidate_correct,"), both=True
    ),
    "compare_by_language": with_scores(OUTCOMES.format(b=PAIR_COLUMNS, m=METRIC_LIST, by="language,", more=""), both=True),
    "compare_regressed": with_scores(" SELECT b.case_id, b.language FROM base b JOIN cand c USING (case_id) WHERE b.core_exact AND NOT c.core_exact", both=True),
    "compare_key_diff": """WITH a AS (SELECT doc_id AS case_id, lang AS language FROM documents WHERE lang <> 'de'),
b AS (SELECT doc_id AS case_id, lang AS language FROM documents JOIN labels USING (doc_id) WHERE lang <> 'fr')
SELECT *, 'base' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'candidate' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "error_types_per_record": with_scores(FAILED + " SELECT type AS error_type, count(DISTINCT case_id) AS records FROM failed GROUP BY type"),
    "error_types_per_occurrence": with_scores(FAILED + " SELECT type AS error_type, count(*) AS occurrences FROM failed GROUP BY type"),
    "error_combinations": with_scores(
        FAILED
        + """ SELECT combination, count(*) AS records FROM (SELECT case_id, string_agg(DISTINCT type, ' + ' ORDER BY type) AS combination FROM failed GROUP BY case_id)
GROUP BY combination ORDER BY records DESC, combination LIMIT 15"""
    ),
    "error_details": with_scores(FAILED + " SELECT case_id, type, symptom, expected, predicted, count FROM failed WHERE type IN ('missing_symptom', 'extra_symptom', 'duplicate_symptom', 'wrong_symptom_status')"),
    "languages_per_case": FAILING + " SELECT case_id, array_to_string(languages, '+') AS languages, n AS n_languages, CASE n WHEN 1 THEN 'single' ELSE 'multi' END AS kind FROM bad",
    "language_combinations": FAILING + " SELECT array_to_string(languages, ' + ') AS combination, count(*) AS cases FROM bad GROUP BY 1 ORDER BY cases DESC, combination LIMIT 15",
    "languages_histogram": FAILING + " SELECT CASE n WHEN 1 THEN 'single' ELSE 'multi' END AS kind, n AS n_languages, count(*) AS cases FROM bad GROUP BY ALL",
    "cross_language_classes": CLASSES + " SELECT class, signature, count(*) AS cases FROM classes GROUP BY ALL",
    "cross_language_capped": CLASSES
    + """ SELECT class, case_id FROM classes QUALIFY row_number() OVER (PARTITION BY class ORDER BY case_id) <= CASE class WHEN 'all_correct' THEN 10 WHEN 'all_failed' THEN 13 ELSE 22 END""",
    "parse_fenced_json": "WITH " + CASES.strip().rstrip(",") + "," + predicted(0, "base").strip() + " SELECT case_id, k NOT IN (8, 9) AS strict_ok, k <> 9 AS lenient_ok, CASE WHEN k <> 9 THEN chief END AS chief FROM base_kind",
    "parse_event_props": """SELECT event_type, count(*) AS total, count(CASE WHEN json_valid(props) THEN (props::JSON ->> 'k')::BIGINT END) AS parsed,
  sum(CASE WHEN json_valid(props) THEN (props::JSON ->> 'k')::BIGINT END)::BIGINT AS sum_k FROM events GROUP BY event_type""",
    "derive_missing": "WITH " + CASES.strip().rstrip(",") + """ SELECT case_id, array_to_string(list_filter([CASE WHEN no_duration THEN 'duration' END,
  CASE WHEN med = 'unknown' THEN 'medications' END, CASE WHEN alg = 'unknown' THEN 'allergies' END], lambda x: x IS NOT NULL), ',') AS missing FROM cases""",
    "validate_case_errors": "WITH " + CASES.strip().rstrip(",") + """
, facts AS (SELECT case_id, len(names) <> len(list_distinct(names)) AS dup, len(list_filter(names, lambda x: x = chief)) <> 1 AS many, chief_status <> 'present' AS bad,
    no_duration, EXISTS (SELECT 1 FROM lines l WHERE l.case_id = cases.case_id AND l.name = cases.chief AND l.value IS NULL) AS lacks FROM cases)
SELECT code, count(*) AS occurrences FROM (
  SELECT 'duplicate_symptoms' AS code FROM facts WHERE dup UNION ALL SELECT 'chief_complaint_count' FROM facts WHERE many
  UNION ALL SELECT 'chief_complaint_status' FROM facts WHERE NOT many AND bad UNION ALL SELECT 'missing_information_mismatch' FROM facts WHERE no_duration <> lacks) GROUP BY code""",
    "sample_coverage": """WITH r AS (SELECT user_id AS case_id, event_type AS language, (user_id % 2)::VARCHAR AS split FROM events WHERE event_type <> 'view' OR user_id % 3 <> 0),
g AS (SELECT case_id, list(DISTINCT language ORDER BY language) AS l, count(DISTINCT split) <> 1 AS crosses_splits FROM r GROUP BY case_id)
SELECT case_id, array_to_string(l, ',') AS languages, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(l, x)), ',') AS missing_languages,
  array_to_string(list_filter(l, lambda x: NOT list_contains(['click', 'purchase', 'view'], x)), ',') AS extra_languages, crosses_splits FROM g""",
    "stratified_split": SPLIT + " SELECT doc_id, lang, split FROM parts",
    "stratified_split_counts": SPLIT + " SELECT lang, split, count(*) AS total FROM parts GROUP BY ALL",
    "split_leakage": """SELECT l_orderkey AS id, 'test,train' AS splits FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber > 5) AND bool_or(l_linenumber <= 5)""",
    "split_completeness": """SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id % 97 = 0 UNION ALL SELECT -1 - range, 'extra' FROM range(3)""",
    "split_repeats": "SELECT l_returnflag AS split, count(*) AS total, count(DISTINCT l_orderkey) AS ids FROM lineitem GROUP BY 1",
    "qc_accept": JUDGED + " SELECT case_id, language FROM judged WHERE s AND k",
    "qc_reject": JUDGED + " SELECT case_id, language, s AS semantic_passed, k AS language_passed FROM judged WHERE NOT coalesce(s, false) OR NOT coalesce(k, false)",
    "qc_unmatched": "SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "qc_report_by_language": JUDGED
    + " SELECT language, count(*) AS total, count(*) FILTER (NOT s) AS semantic_failed, count(*) FILTER (NOT k) AS language_failed, count(*) FILTER (NOT s OR NOT k) AS either_failed FROM judged WHERE s IS NOT NULL GROUP BY language",
    "qc_failure_kinds": JUDGED + " SELECT count(*) FILTER (NOT s AND k) AS semantic_only, count(*) FILTER (s AND NOT k) AS language_only, count(*) FILTER (NOT s AND NOT k) AS both FROM judged WHERE s IS NOT NULL",
    "qc_report_order": SPLIT
    + """, r AS (SELECT doc_id AS case_id, split, lang, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS rank FROM parts JOIN labels USING (doc_id) WHERE quality <> 1 OR toxic <> 0)
SELECT case_id, split, row_number() OVER (ORDER BY rank, lang, case_id) AS ordinal, count(*) OVER () AS total, rank FROM r""",
    "qc_error_types": """SELECT error_type, count(*) AS occurrences FROM (SELECT 'wrong_status' AS error_type FROM labels WHERE quality <> 1 UNION ALL SELECT 'mixed' FROM labels WHERE toxic <> 0
  UNION ALL SELECT 'unknown' FROM labels WHERE quality <> 1 AND toxic <> 0) GROUP BY 1""",
    "coverage_by_group": "WITH "
    + CASES.strip().rstrip(",")
    + COVER
    + """SELECT case_pattern, count(*) AS total, count(*) FILTER (a) AS with_absent, count(*) FILTER (u) AS with_uncertain, count(*) FILTER (d >= 2) AS multiple_durations,
  count(*) FILTER (d = 0) AS no_duration, count(*) FILTER (med = 'reported') AS medications_reported, count(*) FILTER (alg = 'reported') AS allergies_reported, sum(s.n)::BIGINT AS symptoms,
  100.0 * count(*) FILTER (a) / count(*) AS with_absent_pct, 100.0 * count(*) FILTER (u) / count(*) AS with_uncertain_pct, 100.0 * count(*) FILTER (d >= 2) / count(*) AS multiple_durations_pct
FROM cases JOIN s USING (case_id) GROUP BY case_pattern""",
    "coverage_values": "WITH "
    + CASES.strip().rstrip(",")
    + COVER
    + """, vals AS (
  SELECT case_pattern, 'symptom_count' AS field, CASE WHEN s.n >= 4 THEN '4+' ELSE s.n::VARCHAR END AS value FROM cases JOIN s USING (case_id)
  UNION ALL SELECT case_pattern, 'duration_count', CASE WHEN d >= 2 THEN '2+' ELSE d::VARCHAR END FROM cases JOIN s USING (case_id)
  UNION ALL SELECT case_pattern, 'medication_status', med FROM cases UNION ALL SELECT case_pattern, 'allergy_status', alg FROM cases
  UNION ALL SELECT case_pattern, 'symptom_status', status FROM cases JOIN lines USING (case_id)
  UNION ALL SELECT case_pattern, 'missing_information', 'duration' FROM cases WHERE no_duration
  UNION ALL SELECT case_pattern, 'missing_information', 'medications' FROM cases WHERE med = 'unknown'
  UNION ALL SELECT case_pattern, 'missing_information', 'allergies' FROM cases WHERE alg = 'unknown')
SELECT case_pattern, field, value, count(*) AS total FROM vals GROUP BY ALL""",
    "lexical_stats": LEXICAL.format(by="lang"),
    "lexical_stats_by_group": LEXICAL.format(by="lang, source"),
    "top_tokens": top(1, 20),
    "top_bigrams": top(2, 15),
    "top_trigrams": top(3, 15),
    "length_percentiles": """SELECT lang, count(text) AS total, avg(length(text)) AS mean, quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.95) AS p95, max(length(text)) AS max FROM documents GROUP BY lang""",
    "script_digit_profile": """SELECT lang, count(*) AS total, count(*) FILTER (regexp_matches(text, '[ऀ-ॿ]')) AS devanagari, count(*) FILTER (regexp_matches(text, '[؀-ۿ]')) AS arabic,
  count(*) FILTER (regexp_matches(text, '[0-9]')) AS western_digits, count(*) FILTER (regexp_matches(text, '[०-९]')) AS devanagari_digits, count(*) FILTER (regexp_matches(text, '[٠-٩]')) AS arabic_digits
FROM documents GROUP BY lang""",
    "western_digits": """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]'))), '') AS digits FROM documents WHERE regexp_matches(text, '[0-9]')""",
    "arabic_digits": f"""SELECT o_orderkey, CASE WHEN {LANGUAGE.format("o_orderkey")} = 'ar_msa' THEN translate('order ' || o_orderkey, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE 'order ' || o_orderkey END AS text FROM orders""",
    "dedupe_last_wins": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "first_per_case": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""",
    "duplicate_line_keys": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "upsert_repair": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'xx' END AS lang, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS state
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id)""",
    "invalidate_keys": """SELECT doc_id, quality, toxic, CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') THEN 'removed' ELSE 'kept' END AS side FROM labels""",
    "resume_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "repair_overlap": f"""WITH a AS (SELECT c_custkey AS case_id, unnest({LANGS}) AS language FROM customer WHERE c_mktsegment = 'BUILDING'),
b AS (SELECT DISTINCT o_custkey AS case_id, {LANGUAGE.format("o_orderkey")} AS language FROM orders)
SELECT (SELECT count(*) FROM a) AS from_cases, (SELECT count(*) FROM b) AS from_failures, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS all_keys,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS overlap""",
    "repair_changed_by_pattern": "WITH " + CASES.strip().rstrip(",") + " SELECT case_pattern, count(*) AS changed FROM cases WHERE case_pattern IN ('1-URGENT', '2-HIGH') AND alg = 'unknown' GROUP BY case_pattern",
    "deterministic_duration": DURATION,
    "language_expand": f"SELECT doc_id, unnest({LANGS}) AS language FROM documents",
    "generated_pattern_counts": """SELECT * FROM (VALUES ('simple', 150), ('negation', 150), ('uncertainty', 150), ('mixed', 150), ('missing_duration', 100),
  ('missing_medications', 100), ('missing_allergies', 100), ('multiple_present', 100)) t(case_pattern, total)""",
    "generated_case_errors": "SELECT NULL::VARCHAR AS code, NULL::BIGINT AS occurrences WHERE false",
    "chat_messages": """SELECT conv_id, turn, '[{"role":"system","content":"be brief"},{"role":"user","content":' || to_json(text) || '}]' AS messages FROM conversations""",
    "token_budget": AUDITED
    + """ SELECT lang, count(*) AS total, count(*) FILTER (truncated) AS truncated, count(*) FILTER (least(assistant, greatest(0, 512 - prompt)) < assistant) AS targets_truncated,
  avg(full_tokens) AS mean_tokens, quantile_cont(full_tokens, 0.5) AS median_tokens, quantile_cont(full_tokens, 0.95) AS p95_tokens, max(full_tokens) AS max_tokens,
  coalesce(avg(tokens_lost) FILTER (truncated), 0.0) AS mean_lost,
  coalesce(max(CASE WHEN assistant = 0 THEN 0.0 ELSE 100.0 * (assistant - least(assistant, greatest(0, 512 - prompt))) / assistant END), 0.0) AS max_loss_pct FROM a GROUP BY lang""",
    "token_worst": AUDITED + " SELECT doc_id, full_tokens, tokens_lost FROM a ORDER BY tokens_lost DESC, doc_id LIMIT 20",
    "label_masks": """SELECT labels, count(*) AS total FROM (SELECT array_to_string(list_transform(range(1, (l_quantity::INT % 5) + 4), lambda x: CASE WHEN x - 1 < l_linenumber THEN -100 ELSE x END), ',') AS labels
  FROM lineitem) GROUP BY labels""",
    "case_lookup": "WITH " + CASES.strip().rstrip(",") + " SELECT case_id, chief AS chief_complaint FROM cases WHERE case_id IN (SELECT c_custkey FROM customer)",
    "target_consistency": "WITH " + CASES.strip().rstrip(",") + " SELECT CASE WHEN case_id % 17 = 0 THEN 'unknown_case' WHEN case_id % 13 = 0 THEN 'target_differs' ELSE 'equal' END AS state, count(*) AS total FROM cases GROUP BY ALL",
}
