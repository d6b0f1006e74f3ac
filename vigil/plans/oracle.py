"""DuckDB SQL for every oracle-checked query (same column names as the
Spark side).  Written independently of the Spark operators; only the
per-row bridge derivations are shared text."""

from __future__ import annotations

from . import bridge as B

ORACLE: dict[str, str] = {}

_LINE_ORDER = ", ".join(B.LINE_ORDER)
_HDR = ",\n    ".join(f"{e} AS {n}" for n, e in B.HEADER_EXPRS.items())
_LN = ",\n    ".join(f"{e} AS {n}" for n, e in {**B.REACTION_EXPRS, **B.DRUG_EXPRS}.items())
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

# Clean reports, written with windows instead of min_by.
CLEAN_CTE = f"""
hdr AS (
  SELECT o_orderkey AS report_key,
    {_HDR}
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
ln AS (
  SELECT l_orderkey AS report_key, {_LINE_ORDER},
    {_LN}
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
lnr AS (
  SELECT *,
    row_number() OVER (PARTITION BY report_key ORDER BY {_LINE_ORDER}) AS r_first,
    row_number() OVER (PARTITION BY report_key ORDER BY
        CASE WHEN coalesce(drugcharacterization, '') = '1' THEN 0 ELSE 1 END, {_LINE_ORDER}) AS d_first,
    count(*) OVER (PARTITION BY report_key) AS n_lines,
    count(*) FILTER (WHERE drugcharacterization = '2') OVER (PARTITION BY report_key) AS n_conc
  FROM ln),
st AS (
  SELECT h.*, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.n_conc, 0) AS n_conc,
    {TRIM.format("coalesce(f.reactionmeddrapt, '')")} AS pt, f.reactionoutcome,
    {TRIM.format("coalesce(s.medicinalproduct, '')")} AS drug,
    s.drugdosagetext, s.drugindication, s.drugadditional, s.drugrecurrence
  FROM hdr h
  LEFT JOIN lnr f ON f.report_key = h.report_key AND f.r_first = 1
  LEFT JOIN lnr s ON s.report_key = h.report_key AND s.d_first = 1),
st2 AS (
  SELECT *,
    CASE WHEN n_lines = 0 THEN 'no_reaction' WHEN pt = '' THEN 'blank_pt'
         WHEN drug = '' THEN 'blank_drug' END AS reject_reason
  FROM st),
clean0 AS (
  SELECT safetyreportid AS id, drug AS drug_name, coalesce(drugdosagetext, '') AS drug_dose,
    coalesce(drugindication, '') AS drug_indication, pt AS reaction_pt,
    CASE coalesce(reactionoutcome, '') WHEN '1' THEN 'Recovered/Resolved' WHEN '2' THEN 'Recovering/Resolving'
      WHEN '3' THEN 'Not Recovered' WHEN '4' THEN 'Fatal' ELSE 'Unknown' END AS reaction_outcome,
    coalesce(serious, '2') = '1' AS serious,
    concat_ws('|',
      CASE WHEN seriousnessdeath = '1' THEN 'Death' END,
      CASE WHEN seriousnesslifethreatening = '1' THEN 'Life-threatening' END,
      CASE WHEN seriousnesshospitalization = '1' THEN 'Hospitalization' END,
      CASE WHEN seriousnessdisabling = '1' THEN 'Disability/Incapacity' END,
      CASE WHEN seriousnesscongeni = '1' THEN 'Congenital Anomaly' END,
      CASE WHEN seriousnessother = '1' THEN 'Medically Significant' END) AS seriousness_criteria,
    coalesce(patientonsetage, '') AS patient_age,
    CASE patientsex WHEN '1' THEN 'male' WHEN '2' THEN 'female' ELSE 'unknown' END AS patient_sex,
    {TRIM.format("coalesce(narrativeincludeclinical, '')")} AS narrative,
    coalesce(drugadditional, '') AS drug_additional, coalesce(drugrecurrence, '') AS drug_recurrence,
    CAST(n_conc AS INTEGER) AS concomitant_drugs
  FROM st2 WHERE reject_reason IS NULL),
clean AS (
  SELECT id, drug_name, drug_dose, drug_indication, reaction_pt, reaction_outcome, serious,
    seriousness_criteria, patient_age, patient_sex, narrative, narrative <> '' AS has_narrative,
    drug_additional, drug_recurrence, concomitant_drugs,
    {{WHO_UMC}} AS who_umc_preliminary
  FROM clean0)
"""

WHO_UMC = """CASE
      WHEN drug_recurrence = '1' AND drug_additional IN ('1', '2') THEN 'Certain'
      WHEN drug_additional IN ('1', '2') AND reaction_outcome IN ('Recovered/Resolved', 'Recovering/Resolving') THEN 'Probable/Likely'
      WHEN reaction_outcome IN ('Recovered/Resolved', 'Recovering/Resolving') AND serious THEN 'Probable/Likely'
      WHEN reaction_outcome IN ('Recovered/Resolved', 'Recovering/Resolving') THEN 'Possible'
      WHEN reaction_outcome = 'Fatal' THEN 'Possible'
      WHEN reaction_outcome = 'Not Recovered' THEN 'Unlikely'
      ELSE 'Unassessable' END"""

CLEAN_CTE = CLEAN_CTE.replace("{WHO_UMC}", WHO_UMC)


def with_clean(body: str) -> str:
    return "WITH " + CLEAN_CTE + body


ORACLE["report_normalize"] = with_clean("SELECT * FROM clean")
ORACLE["report_rejects"] = ("WITH " + CLEAN_CTE.split("clean0 AS")[0].rstrip().rstrip(",")
                            + "\nSELECT safetyreportid AS id, reject_reason FROM st2 WHERE reject_reason IS NOT NULL")
ORACLE["causality_by_category"] = with_clean(
    "SELECT who_umc_preliminary AS category, count(*) AS n FROM clean GROUP BY 1")
ORACLE["causality_distribution"] = with_clean(
    ", vc AS (SELECT who_umc_preliminary AS category, count(*) AS n FROM clean GROUP BY 1)\n"
    "SELECT category, n, CAST(n AS DOUBLE) / CAST((SELECT sum(n) FROM vc) AS DOUBLE) AS share FROM vc")
ORACLE["suspect_drug_pick"] = with_clean(
    "SELECT id, drug_name, drug_dose, drug_indication, drug_additional, drug_recurrence FROM clean")
ORACLE["criteria_counts"] = with_clean(
    ", ex AS (SELECT unnest(string_split(seriousness_criteria, '|')) AS criterion FROM clean "
    "WHERE seriousness_criteria <> '')\nSELECT criterion, count(*) AS n FROM ex GROUP BY 1")
ORACLE["concomitant_count"] = with_clean(
    "SELECT concomitant_drugs, count(*) AS n FROM clean GROUP BY 1")
ORACLE["outcome_sex_decode"] = with_clean(
    "SELECT reaction_outcome, patient_sex, count(*) AS n FROM clean GROUP BY 1, 2")
ORACLE["schema_backfill"] = with_clean(
    f"""SELECT id,
      CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '' ELSE drug_additional END AS drug_additional,
      CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '' ELSE drug_recurrence END AS drug_recurrence,
      CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 0 ELSE concomitant_drugs END AS concomitant_drugs,
      CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN
        {WHO_UMC.replace("drug_recurrence", "''").replace("drug_additional", "''")}
      ELSE who_umc_preliminary END AS who_umc_preliminary
    FROM clean""")
ORACLE["report_profile"] = with_clean(
    """SELECT count(*) AS n_reports, count_if(has_narrative) AS n_with_narrative,
      avg(CAST(has_narrative AS INTEGER)) AS share_with_narrative,
      count_if(serious) AS n_serious, avg(CAST(serious AS INTEGER)) AS share_serious FROM clean""")
ORACLE["top_reactions"] = with_clean(
    "SELECT reaction_pt, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, reaction_pt LIMIT 10")
ORACLE["top_drugs"] = with_clean(
    "SELECT drug_name, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, drug_name LIMIT 10")


# ------------------------------------------------------------ dictionary ----
DICT_CTE = f"""
pts AS (SELECT {B.PT_BASE} + min(p_partkey) AS term_id, p_name AS name FROM part GROUP BY p_name),
hlts AS (SELECT {B.HLT_BASE} + min(p_partkey) AS term_id, lower(p_type) || ' conditions' AS name FROM part GROUP BY p_type),
socs AS (SELECT {B.SOC_BASE} + r_regionkey AS term_id, lower(r_name) || ' disorders' AS name FROM region),
llts AS (SELECT {B.LLT_BASE} + p_partkey AS term_id, p_name || ' nos' AS name, p_name FROM part),
names AS (
  SELECT term_id, name, term_id * 2 + 1 AS pos FROM pts
  UNION ALL SELECT term_id, upper(name), term_id * 2 FROM pts WHERE term_id % 3 = 0
  UNION ALL SELECT term_id, name, term_id * 2 + 1 FROM hlts
  UNION ALL SELECT term_id, name, term_id * 2 + 1 FROM socs
  UNION ALL SELECT term_id, name, term_id * 2 + 1 FROM llts),
levels AS (
  SELECT term_id, 'PT' AS level, term_id AS pos FROM pts
  UNION ALL SELECT term_id, 'HLT', term_id FROM hlts
  UNION ALL SELECT term_id, 'SOC', term_id FROM socs
  UNION ALL SELECT term_id, 'LLT', term_id FROM llts),
ptp AS (SELECT {B.PT_BASE} + min(p_partkey) AS child_id, length(p_name) AS len, min(p_type) AS t
        FROM part GROUP BY p_name),
htk AS (SELECT p_type, min(p_partkey) AS hk FROM part GROUP BY p_type),
edges0 AS (
  SELECT child_id, {B.HLT_BASE} + hk AS parent_id, 1 AS slot FROM ptp JOIN htk ON t = p_type
  UNION ALL SELECT child_id, {B.SOC_BASE} + len % 5, 2 FROM ptp WHERE len % 11 <> 0
  UNION ALL SELECT child_id, {B.SOC_BASE} + (len + 1) % 5, CASE WHEN len % 7 = 0 THEN 0 ELSE 3 END
            FROM ptp WHERE len % 11 <> 0 AND (len % 2 = 0 OR len % 7 = 0)
  UNION ALL SELECT l.term_id, p.term_id, 0 FROM llts l JOIN pts p ON l.p_name = p.name),
edges AS (SELECT child_id, parent_id, child_id * 4 + slot AS pos FROM edges0),
tn AS (SELECT term_id, arg_max(name, pos) AS name FROM names GROUP BY term_id),
tl AS (SELECT term_id, arg_max(level, pos) AS level, min(pos) AS level_pos FROM levels GROUP BY term_id),
fsoc AS (SELECT child_id, arg_min(parent_id, pos) AS soc_id FROM edges
         WHERE parent_id IN (SELECT term_id FROM tl WHERE level = 'SOC') GROUP BY child_id),
fsoc2 AS (SELECT f.child_id, f.soc_id, coalesce(trim(tn.name), '') AS soc_name
          FROM fsoc f LEFT JOIN tn ON tn.term_id = f.soc_id),
ptrows AS (SELECT tl.term_id, tl.level_pos, trim(coalesce(tn.name, '')) AS pt_name, s.soc_id, s.soc_name
           FROM tl LEFT JOIN tn ON tn.term_id = tl.term_id LEFT JOIN fsoc2 s ON s.child_id = tl.term_id
           WHERE tl.level = 'PT'),
lookup AS (
  SELECT lower(pt_name) AS pt_key, min(level_pos) AS key_pos,
    arg_max(pt_name, level_pos) AS meddra_pt, arg_max(term_id, level_pos) AS meddra_pt_code,
    arg_max(pt_name, level_pos) AS meddra_llt, arg_max(term_id, level_pos) AS meddra_llt_code,
    coalesce(arg_max(soc_name, level_pos), '') AS meddra_soc, arg_max(soc_id, level_pos) AS meddra_soc_code
  FROM ptrows WHERE pt_name <> '' GROUP BY 1)
"""


def with_dict(body: str) -> str:
    return "WITH " + DICT_CTE + body


def with_clean_dict(body: str) -> str:
    return "WITH " + CLEAN_CTE + "," + DICT_CTE + body


ORACLE["dict_names"] = with_dict("SELECT term_id, name FROM tn")
ORACLE["dict_first_soc"] = with_dict("SELECT child_id, soc_id, soc_name FROM fsoc2")
ORACLE["dict_lookup"] = with_dict("SELECT * FROM lookup")
ORACLE["dict_soc_coverage"] = with_dict(
    """SELECT count(*) AS n_pt, count_if(pt_name = '') AS n_skipped, count_if(soc_id IS NOT NULL) AS n_with_soc,
       CAST(count_if(soc_id IS NOT NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS soc_share FROM ptrows""")
ORACLE["dict_level_counts"] = with_dict("SELECT level, count(*) AS n FROM tl GROUP BY level")
ORACLE["dict_adjacency"] = with_dict(
    """SELECT child_id, count(*) AS n_parents, arg_min(parent_id, pos) AS first_parent,
       arg_max(parent_id, pos) AS last_parent FROM edges GROUP BY child_id""")
ORACLE["dict_children"] = with_dict(
    """SELECT parent_id, count(*) AS n_children, arg_min(child_id, pos) AS first_child
       FROM edges GROUP BY parent_id""")

# exact coding: key = lower(trim(reaction_pt)); reaction_pt is already trimmed
_CODED = """
, coded AS (
  SELECT c.id, c.reaction_pt, k.meddra_pt, k.meddra_pt_code, k.meddra_soc, k.meddra_soc_code
  FROM clean c LEFT JOIN lookup k ON k.pt_key = lower(c.reaction_pt))"""
ORACLE["code_exact"] = with_clean_dict(_CODED + "\nSELECT * FROM coded")

# fuzzy (edit-distance score): best key per distinct miss, ties -> lowest key_pos
_FUZZY = """
, misses AS (SELECT DISTINCT lower(reaction_pt) AS term FROM coded WHERE meddra_pt IS NULL),
scored AS (
  SELECT m.term, k.pt_key, k.key_pos,
    CAST(100 * (greatest(length(m.term), length(k.pt_key)) - levenshtein(m.term, k.pt_key)) AS DOUBLE)
      / CAST(greatest(length(m.term), length(k.pt_key)) AS DOUBLE) AS score
  FROM misses m, lookup k),
best AS (
  SELECT term, pt_key, key_pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, key_pos) AS rn FROM scored)
  WHERE rn = 1)"""
ORACLE["code_fuzzy_lev"] = with_clean_dict(
    _CODED + _FUZZY + """
SELECT term, CASE WHEN score >= 80 THEN pt_key END AS pt_key, CASE WHEN score >= 80 THEN score END AS score,
  score >= 80 AS accepted FROM best""")
_SORTED = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_FORM = "(CAST(100 * (greatest(length({a}), length({b})) - levenshtein({a}, {b})) AS DOUBLE) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"
ORACLE["code_fuzzy_weighted"] = with_clean_dict(_CODED + f"""
, misses AS (SELECT DISTINCT lower(reaction_pt) AS term FROM coded WHERE meddra_pt IS NULL),
scored AS (
  SELECT m.term, k.pt_key, k.key_pos,
    greatest({_FORM.format(a="m.term", b="k.pt_key")},
             {_FORM.format(a=_SORTED.format(c="m.term"), b=_SORTED.format(c="k.pt_key"))} * 0.95) AS score
  FROM misses m, lookup k),
best AS (
  SELECT term, pt_key, score FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, key_pos) AS rn FROM scored WHERE score >= 80)
  WHERE rn = 1)
SELECT *, 'exact' AS match_type, 100.0::DOUBLE AS match_score FROM coded WHERE meddra_pt IS NOT NULL
UNION ALL
SELECT c.id, c.reaction_pt, k.meddra_pt, k.meddra_pt_code, k.meddra_soc, k.meddra_soc_code,
  CASE WHEN k.meddra_pt IS NULL THEN 'none' ELSE 'fuzzy' END, b.score
FROM coded c LEFT JOIN best b ON b.term = lower(c.reaction_pt) LEFT JOIN lookup k ON k.pt_key = b.pt_key
WHERE c.meddra_pt IS NULL""")
ORACLE["code_drop_unmatched"] = with_clean_dict(
    _CODED + _FUZZY + """
, fz AS (
  SELECT c.id, c.reaction_pt, k.meddra_pt, k.meddra_pt_code, k.meddra_soc, k.meddra_soc_code, 'fuzzy' AS match_type
  FROM coded c JOIN best b ON b.term = lower(c.reaction_pt) AND b.score >= 80
  JOIN lookup k ON k.pt_key = b.pt_key
  WHERE c.meddra_pt IS NULL)
SELECT *, 'exact' AS match_type FROM coded WHERE meddra_pt IS NOT NULL
UNION ALL SELECT * FROM fz""")
ORACLE["code_coverage"] = with_clean_dict(
    _CODED + _FUZZY + """
, terms AS (SELECT DISTINCT reaction_pt FROM clean),
t2 AS (
  SELECT t.reaction_pt,
    (k.pt_key IS NOT NULL) OR (b.score >= 80) AS matched
  FROM terms t LEFT JOIN lookup k ON k.pt_key = lower(t.reaction_pt)
  LEFT JOIN best b ON b.term = lower(t.reaction_pt))
SELECT count(*) AS n_terms, count_if(matched) AS n_matched, count_if(NOT matched) AS n_unmatched,
  CAST(count_if(matched) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS matched_share FROM t2""")
ORACLE["code_attach_predictions"] = (
    "WITH " + CLEAN_CTE.split("lnr AS")[0].rstrip().rstrip(",") + "," + DICT_CTE + """
, pred AS (
  SELECT report_key, reactionmeddrapt AS meddra_pt,
    CASE WHEN report_key % 3 = 0 THEN NULL ELSE 'predicted ' || drugindication END AS meddra_soc
  FROM ln)
SELECT p.report_key, p.meddra_pt, k.meddra_pt_code,
  CASE WHEN coalesce(k.meddra_soc, '') <> '' THEN k.meddra_soc ELSE p.meddra_soc END AS meddra_soc,
  k.meddra_soc_code
FROM pred p LEFT JOIN lookup k ON k.pt_key = lower(coalesce(p.meddra_pt, ''))""")


# ---------------------------------------------------------------- labels ----
LABEL_CTE = """
brands AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part),
bnames AS (SELECT DISTINCT p_name FROM part),
mention0 AS (
  SELECT br.p_brand, br.b,
    string_agg('Reports of ' || lower(n.p_name) || ' were observed in clinical trials.', ' '
               ORDER BY 'Reports of ' || lower(n.p_name) || ' were observed in clinical trials.') AS adr
  FROM brands br JOIN bnames n ON length(n.p_name) % 3 = (3 - br.b % 3) % 3
  GROUP BY 1, 2),
mention AS (
  SELECT p_brand, b, CASE WHEN b % 8 = 5 THEN repeat('Problème général : voir la notice. ', 80) || adr
                          WHEN b % 8 = 1 THEN replace(adr, ' were ', chr(10) || 'were ') ELSE adr END AS adr FROM mention0),
lrows AS (
  SELECT 'brand' AS key_type, p_brand AS key, [adr] AS adverse_reactions, []::VARCHAR[] AS warnings_and_cautions,
         NULL::VARCHAR[] AS warnings, b * 10 AS pos FROM mention WHERE b % 4 = 1
  UNION ALL SELECT 'generic', p_brand, [adr], []::VARCHAR[], NULL::VARCHAR[], b * 10 + 1 FROM mention WHERE b % 4 = 2
  UNION ALL SELECT 'brand', p_brand, []::VARCHAR[], ['Use caution when prescribing ' || p_brand || '.'],
         NULL::VARCHAR[], b * 10 + 2 FROM mention WHERE b % 4 = 3
  UNION ALL SELECT 'generic', p_brand, [adr], []::VARCHAR[], NULL::VARCHAR[], b * 10 + 3 FROM mention WHERE b % 4 = 3
  UNION ALL SELECT 'substance', p_brand, [adr], []::VARCHAR[], NULL::VARCHAR[], b * 10 + 4 FROM mention WHERE b % 8 = 0),
firstdoc AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_type, key ORDER BY pos) AS rn FROM lrows) WHERE rn = 1),
hits AS (
  SELECT key AS drug_name, key_type,
    CASE key_type WHEN 'brand' THEN 0 WHEN 'generic' THEN 1 WHEN 'substance' THEN 2 END AS prio,
    CASE WHEN len(coalesce(adverse_reactions, [])) > 0 THEN adverse_reactions[1]
         WHEN len(coalesce(coalesce(warnings_and_cautions, warnings), [])) > 0
           THEN coalesce(warnings_and_cautions, warnings)[1] END AS label_text,
    CASE WHEN len(coalesce(adverse_reactions, [])) > 0 THEN substr(adverse_reactions[1], 1, 2500)
         WHEN len(coalesce(coalesce(warnings_and_cautions, warnings), [])) > 0
           THEN substr(coalesce(warnings_and_cautions, warnings)[1], 1, 1500) END AS label_excerpt,
    CASE WHEN len(coalesce(adverse_reactions, [])) > 0 THEN 'adverse_reactions'
         WHEN len(coalesce(coalesce(warnings_and_cautions, warnings), [])) > 0 THEN 'warnings' END AS label_section
  FROM firstdoc),
besthit AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drug_name ORDER BY prio) AS rn FROM hits
                 WHERE label_text IS NOT NULL) WHERE rn = 1),
drugs AS (SELECT DISTINCT drug_name FROM clean),
label_cache AS (
  SELECT d.drug_name, coalesce(h.label_text, '') AS label_text,
    coalesce(h.label_excerpt, '') AS label_excerpt, h.label_section, h.key_type AS label_key_type
  FROM drugs d LEFT JOIN besthit h ON h.drug_name = d.drug_name)
"""

_PAT = "'(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])\\Q' || lower({pt}) || '\\E($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])'"


def expected_cols(src: str, pt: str = "reaction_pt") -> str:
    pat = _PAT.format(pt=pt)
    return f"""
  SELECT {src}.*,
    CASE WHEN label_text <> '' AND regexp_matches(lower(regexp_replace(label_text, '\\s+', ' ', 'g')), {pat}) THEN 'Expected'
         WHEN label_text <> '' THEN 'Unexpected' END AS labelling_status,
    CASE WHEN label_text <> '' AND regexp_matches(lower(regexp_replace(label_text, '\\s+', ' ', 'g')), {pat})
           THEN list_filter(string_split(regexp_replace(regexp_replace(label_text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)),
                            lambda s: regexp_matches(lower(s), {pat}))[1]
         WHEN label_text <> '' THEN '''' || {pt} || ''' is not mentioned in the label text.'
         ELSE '' END AS labelling_evidence,
    label_text = '' AS needs_review
  FROM {src}"""


LABELLED_CTE = """
, labelled0 AS (
  SELECT c.*, coalesce(lc.label_text, '') AS label_text, coalesce(lc.label_excerpt, '') AS label_excerpt,
    CASE WHEN coalesce(lc.label_text, '') <> '' THEN 'fda_label' ELSE 'llm_knowledge' END AS label_source
  FROM clean c LEFT JOIN label_cache lc ON lc.drug_name = c.drug_name),
labelled AS (""" + expected_cols("labelled0") + ")"


def with_labels(body: str) -> str:
    return "WITH " + CLEAN_CTE + "," + LABEL_CTE + LABELLED_CTE + body


ORACLE["label_cascade"] = with_labels("SELECT * FROM label_cache")
ORACLE["label_expectedness"] = with_labels(
    "SELECT id, drug_name, reaction_pt, label_source, labelling_status, needs_review FROM labelled")
ORACLE["label_evidence"] = with_labels(
    "SELECT id, labelling_evidence FROM labelled WHERE label_source = 'fda_label'")
ORACLE["label_coverage"] = with_labels(
    """SELECT count(*) AS n_drugs, count_if(label_text <> '') AS n_drugs_with_text,
       CAST(count_if(label_text <> '') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share_drugs_with_text,
       (SELECT avg(CAST(label_source = 'fda_label' AS INTEGER)) FROM labelled) AS share_reports_with_text
       FROM label_cache""")

# ------------------------------------------------------------ case build ----
ACTION_SQL = """CASE coalesce({c}, '') WHEN '1' THEN 'The drug was discontinued.'
      WHEN '2' THEN 'The drug dose was reduced.' WHEN '3' THEN 'The drug was continued without change.'
      ELSE 'Not reported' END"""

FIELDS_SQL = f"""
    CASE WHEN drug_dose <> '' THEN ' ' || drug_dose ELSE '' END AS dose_info,
    CASE WHEN patient_age <> '' THEN patient_age || '-year-old ' || patient_sex ELSE patient_sex END AS age_sex,
    CASE WHEN drug_indication <> '' THEN drug_indication ELSE 'unknown indication' END AS indication,
    CASE WHEN serious THEN 'Serious' ELSE 'Non-serious' END AS seriousness,
    {ACTION_SQL.format(c="drug_additional")} AS action_taken"""


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_render(template: str, **cols: str) -> str:
    import string
    parts = []
    for lit, fld, _s, _c in string.Formatter().parse(template):
        if lit:
            parts.append(sql_literal(lit))
        if fld is not None:
            parts.append(cols[fld])
    return "(" + " || ".join(parts) + ")"


def _narrative_prompt_sql() -> str:
    from ..operators import casebuild as CBm
    return sql_render(CBm.NARRATIVE_PROMPT, example=sql_literal(CBm.NARRATIVE_EXAMPLE), drug_name="drug_name",
                      dose_info="dose_info", reaction_pt="reaction_pt", indication="indication",
                      age_sex="age_sex", outcome="reaction_outcome", serious="seriousness",
                      action_taken="action_taken")


def _labelling_prompt_sql() -> str:
    from ..operators import casebuild as CBm
    w = sql_render(CBm.LABELLING_PROMPT_WITH_LABEL, drug_name="drug_name", reaction_pt="reaction_pt",
                   label_excerpt="label_excerpt")
    n = sql_render(CBm.LABELLING_PROMPT_NO_LABEL, drug_name="drug_name", reaction_pt="reaction_pt",
                   indication="indication")
    return f"CASE WHEN label_text <> '' THEN {w} ELSE {n} END"


ORACLE["action_text"] = with_clean(
    f"SELECT id, drug_additional, {ACTION_SQL.format(c='drug_additional')} AS action_taken FROM clean")
ORACLE["prompt_render"] = with_clean(
    f", f AS (SELECT *, {FIELDS_SQL} FROM clean)\nSELECT id, {_narrative_prompt_sql()} AS prompt FROM f")
ORACLE["labelling_prompt_render"] = with_labels(
    f", f AS (SELECT *, {FIELDS_SQL} FROM labelled0)\nSELECT id, {_labelling_prompt_sql()} AS prompt FROM f")
ORACLE["resume_anti_join"] = with_clean(
    "SELECT id FROM clean WHERE id NOT IN (SELECT id FROM clean WHERE serious)")

# generated cases: exact + edit-distance fuzzy coding (unmatched dropped),
# labels, expectedness, template narrative
NARR_SQL = """'A ' || age_sex || ' patient with ' || indication || ' received ' || drug_name || dose_info
      || '. After ' || CAST((length(id) + length(reaction_pt)) % 12 + 1 AS VARCHAR)
      || ' weeks of treatment, the patient developed ' || lower(reaction_pt) || '. '
      || CASE WHEN action_taken = 'Not reported' THEN 'No action with the drug was reported.' ELSE action_taken END
      || ' The event was assessed as ' || lower(seriousness) || ' and the outcome was ' || lower(reaction_outcome) || '.'
      || CASE WHEN seriousness_criteria <> ''
              THEN ' The event led to ' || lower(replace(seriousness_criteria, '|', ', ')) || '.' ELSE '' END"""

CASES_CTE = _CODED + _FUZZY + """
, coded2 AS (
  SELECT c.*, k.meddra_pt AS m_pt, k.meddra_pt_code AS m_pt_code, k.meddra_soc AS m_soc, k.meddra_soc_code AS m_soc_code
  FROM clean c
  LEFT JOIN best b ON b.term = lower(c.reaction_pt) AND b.score >= 80
  JOIN lookup k ON k.pt_key = coalesce((SELECT pt_key FROM lookup WHERE pt_key = lower(c.reaction_pt)), b.pt_key)),
case_in0 AS (
  SELECT c.*, coalesce(lc.label_text, '') AS label_text, coalesce(lc.label_excerpt, '') AS label_excerpt,
    CASE WHEN coalesce(lc.label_text, '') <> '' THEN 'fda_label' ELSE 'llm_knowledge' END AS label_source
  FROM coded2 c LEFT JOIN label_cache lc ON lc.drug_name = c.drug_name),
case_in1 AS (""" + expected_cols("case_in0") + f"""),
case_class AS (SELECT drug_name, m_soc, count(*) AS n_class FROM case_in1 WHERE coalesce(m_soc, '') <> '' GROUP BY 1, 2),
case_drug AS (SELECT drug_name, sum(n_class)::BIGINT AS n_drug FROM case_class GROUP BY 1),
case_n AS (
  SELECT c.*, n_class - 1 AS n_same, n_drug - 1 AS n_others, coalesce(needs_review AND n_drug - 1 >= 3, false) AS by_class
  FROM case_in1 c LEFT JOIN case_class k ON k.drug_name = c.drug_name AND k.m_soc = c.m_soc
  LEFT JOIN case_drug d ON d.drug_name = k.drug_name),
case_in2 AS (
  SELECT * EXCLUDE (by_class) REPLACE (
    CASE WHEN by_class THEN CASE WHEN n_same * 100 >= n_others * 20 THEN 'Expected' ELSE 'Unexpected' END ELSE labelling_status END AS labelling_status,
    CASE WHEN by_class THEN n_same || ' of ' || n_others || ' other reports of ' || drug_name || ' concern ' || m_soc || '.'
         ELSE labelling_evidence END AS labelling_evidence,
    needs_review AND NOT by_class AS needs_review)
  FROM case_n),
case_in AS (SELECT *, {FIELDS_SQL} FROM case_in2),
cases AS (
  SELECT id, regexp_replace(regexp_replace({NARR_SQL}, '(?i)^Narrative:\\s*', ''), '^\\s+|\\s+$', '', 'g') AS narrative,
    'generated' AS narrative_source, seriousness, seriousness_criteria,
    m_pt AS meddra_llt, m_pt_code AS meddra_llt_code, m_pt AS meddra_pt, m_pt_code AS meddra_pt_code,
    coalesce(m_soc, '') AS meddra_soc, m_soc_code AS meddra_soc_code, labelling_status,
    coalesce(labelling_evidence, '') AS labelling_evidence, label_source,
    coalesce(who_umc_preliminary, 'Unassessable') AS who_umc_category
  FROM case_in),
validated AS (
  SELECT *,
    CASE WHEN length(narrative) < 100 THEN 'Narrative too short (' || CAST(length(narrative) AS VARCHAR) || ' chars)'
         WHEN coalesce(meddra_pt, '') = '' THEN 'Missing meddra_pt'
         WHEN coalesce(seriousness IN ('Serious', 'Non-serious'), false) = false
           THEN 'Invalid seriousness: ' || coalesce(seriousness, 'None')
         WHEN coalesce(who_umc_category IN ('Certain', 'Probable/Likely', 'Possible', 'Unlikely',
              'Conditional/Unclassified', 'Unassessable'), false) = false
           THEN 'Invalid who_umc_category: ' || coalesce(who_umc_category, 'None')
         WHEN coalesce(labelling_status IN ('Expected', 'Unexpected'), false) = false
           THEN 'Invalid labelling_status: ' || coalesce(labelling_status, 'None') END AS reject_reason
  FROM cases),
valid AS (SELECT * EXCLUDE (reject_reason) FROM validated WHERE reject_reason IS NULL)
"""


def _jstr(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') "
            f"|| '\"' END")


def _jnum(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'null')"


TARGET_JSON_SQL = ("'{' || chr(10) || '  \"seriousness\": ' || " + _jstr("seriousness")
                   + " || ',' || chr(10) || '  \"seriousness_criteria\": ' || "
                   "CASE WHEN seriousness_criteria = '' THEN '[]' ELSE '[' || chr(10) || '    \"' "
                   "|| replace(seriousness_criteria, '|', '\",' || chr(10) || '    \"') || '\"' || chr(10) || '  ]' END"
                   + " || ',' || chr(10) || '  \"meddra_pt\": ' || " + _jstr("meddra_pt")
                   + " || ',' || chr(10) || '  \"meddra_pt_code\": ' || " + _jnum("meddra_pt_code")
                   + " || ',' || chr(10) || '  \"meddra_soc\": ' || " + _jstr("meddra_soc")
                   + " || ',' || chr(10) || '  \"meddra_soc_code\": ' || " + _jnum("meddra_soc_code")
                   + " || ',' || chr(10) || '  \"labelling_status\": ' || " + _jstr("labelling_status")
                   + " || ',' || chr(10) || '  \"labelling_evidence\": ' || " + _jstr("labelling_evidence")
                   + " || ',' || chr(10) || '  \"who_umc_category\": ' || " + _jstr("who_umc_category")
                   + " || chr(10) || '}'")


def _chat_user_sql() -> str:
    from ..functions import chat as CHm
    return sql_literal(CHm.INSTRUCTION + "\n\nNarrative:\n") + " || narrative"


def _flat_sql() -> str:
    from ..functions import chat as CHm
    return ("'<|im_start|>system' || chr(10) || " + sql_literal(CHm.SYSTEM_PROMPT) + " || '<|im_end|>' || chr(10) || "
            "'<|im_start|>user' || chr(10) || " + _chat_user_sql() + " || '<|im_end|>' || chr(10) || "
            "'<|im_start|>assistant' || chr(10) || " + TARGET_JSON_SQL + " || '<|im_end|>'")


def with_cases(body: str) -> str:
    return "WITH " + CLEAN_CTE + "," + DICT_CTE + "," + LABEL_CTE + CASES_CTE + body


ORACLE["narrative_template"] = with_cases("SELECT id, narrative FROM cases")
ORACLE["case_records"] = with_cases("SELECT * FROM cases")
ORACLE["strip_echo"] = with_cases("SELECT id, narrative FROM cases")
ORACLE["seriousness_rules"] = with_cases(
    """, sr AS (SELECT id, concat_ws('|',
      CASE WHEN regexp_matches(narrative, '(?i)\\b(died|death|fatal)\\b') THEN 'Death' END,
      CASE WHEN regexp_matches(narrative, '(?i)life[- ]threatening') THEN 'Life-threatening' END,
      CASE WHEN regexp_matches(narrative, '(?i)\\b(hospitali[sz]\\w*|admitted)\\b') THEN 'Hospitalization' END,
      CASE WHEN regexp_matches(narrative, '(?i)\\b(permanent disability|disabilit\\w*|incapacit\\w*)\\b') THEN 'Disability/Incapacity' END,
      CASE WHEN regexp_matches(narrative, '(?i)\\b(congenital|birth defect)\\b') THEN 'Congenital Anomaly' END,
      CASE WHEN regexp_matches(narrative, '(?i)\\bmedically significant\\b') THEN 'Medically Significant' END) AS pred_criteria
    FROM cases)
SELECT id, CASE WHEN pred_criteria <> '' THEN 'Serious' ELSE 'Non-serious' END AS pred_seriousness, pred_criteria FROM sr""")
_BROKEN = """
    CASE WHEN CAST(id AS BIGINT) % 41 = 0 THEN left(narrative, 99) ELSE narrative END AS narrative,
    CASE CAST(id AS BIGINT) % 43 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE meddra_pt END AS meddra_pt,
    CASE CAST(id AS BIGINT) % 47 WHEN 3 THEN 'Maybe' WHEN 4 THEN NULL ELSE seriousness END AS seriousness,
    CASE WHEN CAST(id AS BIGINT) % 53 = 5 THEN 'Likely' ELSE who_umc_category END AS who_umc_category,
    CASE WHEN CAST(id AS BIGINT) % 59 = 6 THEN 'Unknown' ELSE labelling_status END AS labelling_status"""
ORACLE["validate_reasons"] = with_cases(
    ", broken AS (SELECT * REPLACE (" + _BROKEN + ") FROM cases),\nbroken_validated AS ("
    + CASES_CTE.split("validated AS (")[1].split("FROM cases")[0] + """FROM broken)
SELECT reject_reason,
      CASE WHEN reject_reason LIKE 'Narrative too short%' THEN 'too_short'
           WHEN reject_reason = 'Missing meddra_pt' THEN 'missing_pt'
           WHEN reject_reason LIKE 'Invalid seriousness%' THEN 'bad_seriousness'
           WHEN reject_reason LIKE 'Invalid who_umc%' THEN 'bad_causality' ELSE 'bad_labelling' END AS reason_code,
      count(*) AS n FROM broken_validated WHERE reject_reason IS NOT NULL GROUP BY 1, 2""")
ORACLE["chat_messages"] = with_cases(
    f"SELECT id, 'system|user|assistant' AS roles, {_chat_user_sql()} AS user_content, "
    f"{TARGET_JSON_SQL} AS assistant_content FROM valid")
ORACLE["chat_flat_text"] = with_cases(f"SELECT id, {_flat_sql()} AS text FROM valid")
ORACLE["token_estimate"] = with_cases(f"SELECT id, CAST(length({_flat_sql()}) // 4 AS BIGINT) AS n_tokens FROM valid")
ORACLE["narrative_roundtrip"] = with_cases(
    """SELECT id, narrative, seriousness AS gold_seriousness, meddra_pt AS gold_meddra_pt,
       meddra_soc_code AS gold_meddra_soc_code, labelling_status AS gold_labelling_status FROM valid""")
ORACLE["length_describe"] = with_cases(
    f""", t AS (SELECT CAST(length({_flat_sql()}) // 4 AS DOUBLE) AS x FROM valid)
SELECT count(x) AS count, round_even(avg(x), 0) AS mean, round_even(stddev_samp(x), 0) AS std,
  round_even(min(x), 0) AS min, round_even(quantile_cont(x, 0.25), 0) AS q25,
  round_even(quantile_cont(x, 0.5), 0) AS q50, round_even(quantile_cont(x, 0.75), 0) AS q75,
  round_even(max(x), 0) AS max, count_if(x > 2048) AS over_2048, count_if(x > 1024) AS over_1024 FROM t""")
ORACLE["document_length_describe"] = (
    """WITH t AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents)
SELECT count(x) AS count, round_even(avg(x), 0) AS mean, round_even(stddev_samp(x), 0) AS std,
  round_even(min(x), 0) AS min, round_even(quantile_cont(x, 0.25), 0) AS q25,
  round_even(quantile_cont(x, 0.5), 0) AS q50, round_even(quantile_cont(x, 0.75), 0) AS q75,
  round_even(max(x), 0) AS max FROM t""")
ORACLE["case_profile"] = with_cases(
    """, kv AS (
  SELECT 'seriousness' AS "column", coalesce(seriousness, 'None') AS value FROM cases
  UNION ALL SELECT 'labelling_status', coalesce(labelling_status, 'None') FROM cases
  UNION ALL SELECT 'label_source', coalesce(label_source, 'None') FROM cases
  UNION ALL SELECT 'who_umc_category', coalesce(who_umc_category, 'None') FROM cases
  UNION ALL SELECT 'narrative_source', coalesce(narrative_source, 'None') FROM cases)
SELECT "column", value, count(*) AS n FROM kv GROUP BY 1, 2""")
ORACLE["top_socs"] = with_cases(
    "SELECT meddra_soc, count(*) AS n FROM cases GROUP BY 1 ORDER BY n DESC, meddra_soc LIMIT 5")
ORACLE["short_input_gate"] = (
    """SELECT conv_id, turn,
      CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'Please enter a clinical narrative.'
           WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 60 THEN 'Narrative is too short. Please provide a complete clinical case description (patient demographics, drug, adverse event, outcome).' END
        AS reject_reason
    FROM conversations WHERE role = 'user'""")
ORACLE["narrative_pull"] = (
    """WITH u AS (
  SELECT conv_id, turn,
    CASE WHEN instr(text, 'Narrative:' || chr(10)) > 0
           THEN regexp_replace(substr(text, instr(text, 'Narrative:' || chr(10)) + 11), '^\\s+|\\s+$', '', 'g')
         WHEN instr(text, 'Narrative: ') > 0
           THEN regexp_replace(substr(text, instr(text, 'Narrative: ') + 11), '^\\s+|\\s+$', '', 'g') END AS n
  FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, arg_min(n, turn) AS n FROM u WHERE n IS NOT NULL GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.n, '') AS narrative FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN f ON f.conv_id = c.conv_id""")


# ------------------------------------------------------- JSON extraction ----
def _outputs_cte() -> str:
    from . import catalog as K
    return (f"WITH ev AS (SELECT event_id, {K.OUTPUT_OBJECT.replace('AS STRING', 'AS VARCHAR')} AS obj, event_type "
            f"FROM events), m AS (SELECT event_id, {K.OUTPUT_FORMS} AS raw FROM ev)")


_B1 = r"\{[^{}]*\}"
_B2 = r"\{[^{}]*(?:" + _B1 + r"[^{}]*)*\}"
_B3 = r"\{[^{}]*(?:" + _B2 + r"[^{}]*)*\}"
_OBJ = "CASE WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' THEN {x} END"
_TR = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _nz(x: str) -> str:
    return f"nullif({x}, '')"


def _tiers_sql() -> str:
    t = _TR.format(x="raw")
    fence = _nz(f"regexp_extract({t}, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1)")
    greedy = _nz(f"regexp_extract({t}, '(?s)(\\{{.*\\}})', 1)")
    return f"coalesce({_OBJ.format(x=t)}, {_OBJ.format(x=fence)}, {_OBJ.format(x=greedy)})"


def _robust_sql() -> str:
    t = _TR.format(x="regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g')")
    fence = _nz(f"regexp_extract({t}, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1)")
    from_first = f"substr({t}, instr({t}, '{{'))"
    bal = _nz(f"regexp_extract({from_first}, '^({_B3})', 1)")
    return f"coalesce({_OBJ.format(x=fence)}, {_OBJ.format(x=bal)})"


def _json_select(v: str) -> str:
    return (f"SELECT event_id, {v} IS NOT NULL AS parse_ok, json_extract_string({v}, '$.event') AS event, "
            f"CAST(json_extract({v}, '$.user') AS BIGINT) AS user, "
            f"CAST(json_extract({v}, '$.props.k') AS BIGINT) AS k FROM m")


ORACLE["json_fenced"] = _outputs_cte() + "\n" + _json_select(_tiers_sql())
ORACLE["json_depth_scan"] = _outputs_cte() + "\n" + _json_select(_robust_sql())
ORACLE["think_strip"] = _outputs_cte() + """
SELECT event_id, regexp_replace(replace(regexp_replace(raw || '<|im_end|>', '(?s)<think>.*?</think>', '', 'g'),
  '<|im_end|>', ''), '^\\s+|\\s+$', '', 'g') AS text FROM m"""


# ------------------------------------------------------------- evaluation ----
def _pairs_sql(mode: str) -> str:
    from . import catalog as K
    pr, gr = K.PRED_RULES[mode], K.GOLD_RULES
    cols = ", ".join(f"{e} AS p_{k}" for k, e in pr.items())
    g = ", ".join(f"{e} AS g_{k}" for k, e in gr.items())
    return f"""
SELECT doc_id AS idx, doc_id % 5 <> 3 AS parse_ok, text AS narrative, {cols}, {g}
FROM documents JOIN labels USING (doc_id)
WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"""


def _scored_sql(mode: str) -> str:
    return f"""
SELECT idx AS "index", parse_ok, CASE WHEN NOT parse_ok THEN substr(narrative, 1, 80) END AS narrative,
  CASE WHEN parse_ok THEN p_seriousness END AS seriousness_pred, CASE WHEN parse_ok THEN g_seriousness END AS seriousness_gold,
  CASE WHEN parse_ok THEN p_seriousness IS NOT DISTINCT FROM g_seriousness END AS seriousness_match,
  CASE WHEN parse_ok THEN p_labelling_status END AS labelling_pred, CASE WHEN parse_ok THEN g_labelling_status END AS labelling_gold,
  CASE WHEN parse_ok THEN p_labelling_status IS NOT DISTINCT FROM g_labelling_status END AS labelling_match,
  CASE WHEN parse_ok THEN p_meddra_pt END AS meddra_pt_pred, CASE WHEN parse_ok THEN g_meddra_pt END AS meddra_pt_gold,
  CASE WHEN parse_ok THEN lower(coalesce(p_meddra_pt, '')) = lower(coalesce(g_meddra_pt, '')) END AS meddra_pt_match,
  CASE WHEN parse_ok THEN p_meddra_soc END AS meddra_soc_pred, CASE WHEN parse_ok THEN g_meddra_soc END AS meddra_soc_gold,
  CASE WHEN parse_ok THEN lower(coalesce(p_meddra_soc, '')) = lower(coalesce(g_meddra_soc, '')) END AS meddra_soc_match
FROM ({_pairs_sql(mode)})"""


def _with_scored(mode: str, name: str = "s") -> str:
    return f"""{name}0 AS ({_scored_sql(mode)}),
{name} AS (SELECT *, seriousness_match AND labelling_match AND meddra_pt_match AND meddra_soc_match AS all_match
      FROM {name}0)"""


_COUNTERS = """count(*) AS total, count_if(parse_ok) AS json_parse_ok,
  count_if(seriousness_match) AS seriousness_match, count_if(labelling_match) AS labelling_match,
  count_if(meddra_pt_match) AS meddra_pt_match, count_if(meddra_soc_match) AS meddra_soc_match,
  count_if(all_match) AS all_fields_match"""


def _rates(src: str, keep: str = "") -> str:
    p = "CAST(greatest(json_parse_ok, 1) AS DOUBLE)"
    r = lambda c, den: f"CASE WHEN total > 0 THEN CAST({c} AS DOUBLE) * 100.0 / {den} END"
    return f"""SELECT {keep}total, json_parse_ok, {r('json_parse_ok', 'CAST(total AS DOUBLE)')} AS parse_rate,
  {r('seriousness_match', p)} AS seriousness_acc, {r('meddra_pt_match', p)} AS meddra_pt_acc,
  {r('meddra_soc_match', p)} AS meddra_soc_acc, {r('labelling_match', p)} AS labelling_acc,
  {r('all_fields_match', p)} AS all_fields_acc FROM {src}"""


ORACLE["eval_scored"] = "WITH " + _with_scored("base") + "\nSELECT * FROM s"
ORACLE["eval_counters"] = "WITH " + _with_scored("base") + f"\nSELECT {_COUNTERS} FROM s"
ORACLE["eval_rates"] = "WITH " + _with_scored("base") + f", c AS (SELECT {_COUNTERS} FROM s)\n" + _rates("c")
ORACLE["eval_running"] = "WITH " + _with_scored("base") + """
, r AS (SELECT "index", parse_ok,
    count(*) OVER w AS evaluated,
    sum(CAST(coalesce(seriousness_match, false) AS INTEGER)) OVER w AS seriousness_match,
    sum(CAST(coalesce(labelling_match, false) AS INTEGER)) OVER w AS labelling_match,
    sum(CAST(coalesce(meddra_pt_match, false) AS INTEGER)) OVER w AS meddra_pt_match
  FROM s WINDOW w AS (ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT "index", evaluated, CAST(seriousness_match AS BIGINT) AS seriousness_match,
  CAST(labelling_match AS BIGINT) AS labelling_match, CAST(meddra_pt_match AS BIGINT) AS meddra_pt_match
FROM r WHERE ("index" + 1) % 10 = 0 AND parse_ok"""
ORACLE["eval_compare"] = ("WITH " + _with_scored("base", "sb") + ", " + _with_scored("tuned", "st") + f"""
, c AS (SELECT 'base' AS mode, {_COUNTERS} FROM sb UNION ALL SELECT 'tuned', {_COUNTERS} FROM st),
r AS ({_rates('c', 'mode, ')}),
r2 AS (SELECT *, (seriousness_acc + meddra_pt_acc + meddra_soc_acc + labelling_acc) / 4.0 AS mean_field_acc FROM r),
long AS (UNPIVOT r2 ON parse_rate, seriousness_acc, meddra_pt_acc, meddra_soc_acc, labelling_acc, all_fields_acc,
         mean_field_acc INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (WHERE mode = 'base') AS base, max(value) FILTER (WHERE mode = 'tuned') AS tuned,
  max(value) FILTER (WHERE mode = 'tuned') - max(value) FILTER (WHERE mode = 'base') AS delta_pts
FROM long GROUP BY metric""")


# ------------------------------------------------------------ tokenising ----
# byte-level ids: n_ids = bytes (<= 2048); masked = through the last template
_TPL = "'<|im_start|>assistant' || chr(10)"
ORACLE["mask_labels"] = with_cases(f""", ft AS (SELECT id, {_flat_sql()} AS text FROM valid),
b AS (SELECT id, least(strlen(text), 2048) AS n_ids,
  CASE WHEN instr(text, {_TPL}) > 0
       THEN strlen(text) - instr(reverse(text), reverse({_TPL})) - strlen({_TPL}) + 1 + strlen({_TPL}) END AS until
  FROM ft)
SELECT id, n_ids, CASE WHEN until IS NULL OR until > n_ids THEN n_ids ELSE until END AS n_masked, n_ids AS n_labels
FROM b""")


# -------------------------------------------------------------- streaming ----
ORACLE["stream_ingest_dedup"] = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _samples_sql() -> str:
    from . import catalog as K
    pr = K.PRED_RULES["base"]
    jv = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"
    obj = ("'{\"seriousness\": ' || " + jv(pr["seriousness"]) + " || ', \"meddra_pt\": ' || "
           + jv(pr["meddra_pt"]) + " || ', \"meddra_soc\": ' || " + jv(pr["meddra_soc"])
           + " || ', \"labelling_status\": ' || " + jv(pr["labelling_status"]) + " || '}'")
    return f"""WITH x AS (SELECT doc_id, {obj} AS obj FROM documents JOIN labels USING (doc_id)
  WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT doc_id AS "index", {K.PRED_FORMS} AS raw_output FROM x ORDER BY doc_id LIMIT 5"""


ORACLE["eval_samples"] = _samples_sql()


ORACLE["narrative_qc"] = with_cases(
    """SELECT count(*) AS n, avg(length(narrative)) AS mean_len,
      avg(CAST(regexp_matches(narrative, '(?i)\\b(after|following|days later|weeks? later|months? later)\\b') AS INTEGER)) AS share_temporal,
      avg(CAST(coalesce(labelling_evidence, '') <> '' AS INTEGER)) AS share_evidence FROM cases""")

# order of the split: md5 of seed and id, which every engine computes alike
_SPLIT = """, split AS (
  SELECT id, seriousness, labelling_status,
    CASE WHEN row_number() OVER (ORDER BY md5('42:' || id), id) <= count(*) OVER () * 9 // 10 THEN 'train' ELSE 'val' END AS split
  FROM valid)"""
ORACLE["split_exact"] = with_cases(_SPLIT + "\nSELECT id, split FROM split")
ORACLE["split_balance"] = with_cases(_SPLIT + """
SELECT split, count(*) AS n, avg(CAST(seriousness = 'Serious' AS INTEGER)) AS share_serious,
  avg(CAST(labelling_status = 'Expected' AS INTEGER)) AS share_expected FROM split GROUP BY split""")
