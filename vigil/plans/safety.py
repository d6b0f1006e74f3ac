"""Registered queries on coded reports: signals, related label terms, class-level evidence,
dictionary versions, drug names, confidence routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import coding as C
from ..operators import dictionary as D
from ..operators import drugnames as DN
from ..operators import evaluate as EV
from ..operators import labels as L
from ..operators import mentions as M
from ..operators import signals as SG
from ..session import read_table, staged
from . import bridge, catalog
from .catalog import query
from .oracle import _LINE_ORDER, CASES_CTE, CLEAN_CTE, DICT_CTE, LABEL_CTE, ORACLE, TRIM, _with_scored, with_cases, with_labels

_LINES_CTE = "WITH " + CLEAN_CTE.split("lnr AS")[0].rstrip().rstrip(",")
assert _LINE_ORDER in _LINES_CTE


# ---------------------------------------------------------------- signals ----
def pair_counts(spark, sf):
    """Every order line's (report, drug, reaction): all drugs and reactions of a report, not the first ones only."""
    lines = bridge.report_lines(spark, sf)
    return SG.counts(lines.withColumn("event", C.exact_key("reactionmeddrapt")), "report_key", "medicinalproduct", "event")


def signal_cells(spark, sf):
    return SG.cells(staged(pair_counts(spark, sf), "pair-counts"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("signal_counts")
def signal_counts(spark, sf):
    return signal_cells(spark, sf)


@query("signal_prr_ror")
def signal_prr_ror(spark, sf):
    return _rounded(SG.prr_ror(signal_cells(spark, sf)), "prr", "prr_low", "prr_high", "ror", "ror_low", "ror_high", "chi2")


@query("signal_ic")
def signal_ic(spark, sf):
    return _rounded(SG.information_component(signal_cells(spark, sf)), "expected", "ic", "ic025", "ic975")


@query("signal_ebgm")
def signal_ebgm(spark, sf):
    """Prior fitted to all pairs (no SQL: tested against plain loops)."""
    return _rounded(SG.ebgm(signal_cells(spark, sf)), "expected", "ebgm", "eb05", "eb95")


_CELLS_SQL = _LINES_CTE + f""",
pr AS (SELECT DISTINCT report_key, medicinalproduct AS drug, lower({TRIM.format("reactionmeddrapt")}) AS event FROM ln
       WHERE medicinalproduct <> '' AND lower({TRIM.format("reactionmeddrapt")}) <> ''),
cells AS (
  SELECT p.drug, p.event, a, nd - a AS b, ne - a AS c, (SELECT count(DISTINCT report_key) FROM pr) - nd - ne + a AS d
  FROM (SELECT drug, event, count(*) AS a FROM pr GROUP BY 1, 2) p
  JOIN (SELECT drug, count(DISTINCT report_key) AS nd FROM pr GROUP BY 1) x ON x.drug = p.drug
  JOIN (SELECT event, count(DISTINCT report_key) AS ne FROM pr GROUP BY 1) y ON y.event = p.event),
f AS (SELECT drug, event, a, b, c, d, a::DOUBLE AS a_, b::DOUBLE AS b_, c::DOUBLE AS c_, d::DOUBLE AS d_, (a + b + c + d)::DOUBLE AS n_ FROM cells)
"""
ORACLE["signal_counts"] = _CELLS_SQL + "SELECT * FROM cells"
ORACLE["signal_prr_ror"] = _CELLS_SQL + f""",
g AS (SELECT *, CASE WHEN c > 0 THEN (a_ * (c_ + d_)) / ((a_ + b_) * c_) END AS prr0, CASE WHEN b > 0 AND c > 0 THEN (a_ * d_) / (b_ * c_) END AS ror0,
        CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN n_ * power(greatest(abs(a_ * d_ - b_ * c_) - n_ / 2, 0), 2)
             / ((a_ + b_) * (c_ + d_) * (a_ + c_) * (b_ + d_)) END AS x2,
        CASE WHEN c > 0 THEN sqrt(1 / a_ - 1 / (a_ + b_) + 1 / c_ - 1 / (c_ + d_)) END AS se,
        CASE WHEN b > 0 AND c > 0 AND d > 0 THEN sqrt(1 / a_ + 1 / b_ + 1 / c_ + 1 / d_) END AS rse FROM f)
SELECT drug, event, a, b, c, d, round(prr0, 6) AS prr, round(exp(ln(prr0) - {SG.Z95} * se), 6) AS prr_low, round(exp(ln(prr0) + {SG.Z95} * se), 6) AS prr_high,
  round(ror0, 6) AS ror, round(exp(ln(CASE WHEN ror0 > 0 THEN ror0 END) - {SG.Z95} * rse), 6) AS ror_low,
  round(exp(ln(CASE WHEN ror0 > 0 THEN ror0 END) + {SG.Z95} * rse), 6) AS ror_high,
  round(x2, 6) AS chi2, coalesce(a >= 3 AND prr0 >= 2 AND x2 >= 4, false) AS is_signal FROM g"""
ORACLE["signal_ic"] = _CELLS_SQL + """,
g AS (SELECT *, (a_ + b_) * (a_ + c_) / n_ AS e FROM f), h AS (SELECT *, log2((a_ + 0.5) / (e + 0.5)) AS i, a_ + 0.5 AS o FROM g)
SELECT drug, event, a, b, c, d, round(e, 6) AS expected, round(i, 6) AS ic, round(i - 3.3 / sqrt(o) - 2 / (o * sqrt(o)), 6) AS ic025,
  round(i + 2.4 / sqrt(o) - 0.5 / (o * sqrt(o)), 6) AS ic975 FROM h"""


# ------------------------------------------------- related terms, class, answers ----
INVERTED_BASE = 50_000_000


def related_dictionary(spark, sf):
    """The dictionary's names, levels and edges, and below each PT of two words an LLT with the words inverted ('b, a')."""
    names, levels, edges = catalog.dict_sheets(spark, sf)
    tn, tl = D.term_names(names), D.term_levels(levels).select("term_id", "level")
    flip = tn.join(tl.where("level = 'PT'"), "term_id").where(F.size(F.split("name", " ")) == 2).select(
        (F.col("term_id") + INVERTED_BASE).alias("child_id"), F.col("term_id").alias("parent_id"),
        F.concat(F.split("name", " ")[1], F.lit(", "), F.split("name", " ")[0]).alias("name"))
    return (tn.unionByName(flip.select(F.col("child_id").alias("term_id"), "name")),
            tl.unionByName(flip.select(F.col("child_id").alias("term_id"), F.lit("LLT").alias("level"))),
            edges.select("child_id", "parent_id").unionByName(flip.select("child_id", "parent_id")))


def inverted_labels(cache):
    """Labels of every fourth brand name their terms with the words inverted, as a dictionary's lower-level terms do."""
    flip = F.substring("drug_name", 7, 9).cast("int") % 4 == 2
    return cache.withColumn("label_text", F.when(flip, F.regexp_replace("label_text", r"Reports of (\w+) (\w+) were", "Reports of $2, $1 were"))
                            .otherwise(F.col("label_text")))


@query("label_related")
def label_related(spark, sf):
    """L2 with related terms: a coded reaction is expected if the label names its preferred term or a term below it."""
    clean = staged(catalog.clean_reports(spark, sf).select("id", "drug_name", "reaction_pt"), "clean")
    coded = C.drop_unmatched(C.code_terms(clean, catalog.lookup_table(spark, sf), scorer="levenshtein"))
    labels = inverted_labels(catalog.label_cache(spark, sf, clean)).where("label_text <> ''").select("drug_name", "label_text")
    labels = staged(labels, "labels")
    found = M.related_findings(labels, M.related_names(*related_dictionary(spark, sf)))
    return L.related_status(coded, labels, found).select(
        "id", "drug_name", "reaction_pt", "meddra_pt_code", "labelling_status", "match_kind", "matched_phrase", "labelling_evidence")


@query("label_mentions")
def label_mentions(spark, sf):
    """The (drug, term) mention table itself: every dictionary term that a drug's label names."""
    clean = catalog.clean_reports(spark, sf).select("drug_name")
    labels = inverted_labels(catalog.label_cache(spark, sf, clean)).where("label_text <> ''")
    return M.mention_table(labels, M.related_names(*related_dictionary(spark, sf))).select("drug_name", "pt_code", "kind", "phrase", "sentence")


@query("label_class_rule")
def label_class_rule(spark, sf):
    """L3: reports of drugs without label text, decided by the organ class of the drug's other reports."""
    return L.class_rule(catalog.assessed_cases(spark, sf)).where(F.col("label_source") == L.LABEL_SOURCE_NONE).select(
        "id", "drug_name", "meddra_soc", "n_same", "n_others", "labelling_status", "labelling_evidence", "needs_review")


#: Fixture: the labelling answer of a report in six forms, some with a status outside the domain, cut or without JSON.
ANSWER = """'{"labelling_status": "' || CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN 'Possibly' ELSE coalesce(labelling_status, 'Unknown') END
  || '", "labelling_evidence": "' || replace(labelling_evidence, chr(34), '') || '"}'"""
ANSWER_FORMS = """CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN obj WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```'
  WHEN 2 THEN 'Assessment: ' || obj || ' (end)' WHEN 3 THEN substr(obj, 1, length(obj) - 2)
  WHEN 4 THEN 'I cannot tell.' ELSE ' ' || obj || chr(10) END"""


def labelling_answers(spark, sf):
    x = catalog.labelled_reports(spark, sf)
    return x.withColumn("obj", F.expr(ANSWER)).select("id", F.expr(ANSWER_FORMS).alias("raw_output"))


@query("label_acceptance")
def label_acceptance(spark, sf):
    """L4: acceptance of raw labelling answers (three-tier parsing, status domain)."""
    return L.accepted(labelling_answers(spark, sf)).drop("raw_output")


@query("label_acceptance_counts")
def label_acceptance_counts(spark, sf):
    out = L.accepted(labelling_answers(spark, sf))
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"
_SENTENCES = r"string_split(regexp_replace(regexp_replace(label_text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))"
_RELATED_CTE = rf"""
, flip AS (SELECT term_id + {INVERTED_BASE} AS child_id, term_id AS parent_id, split_part(name, ' ', 2) || ', ' || split_part(name, ' ', 1) AS name
           FROM tn JOIN tl USING (term_id) WHERE level = 'PT' AND len(string_split(name, ' ')) = 2),
rl AS (SELECT drug_name, CASE WHEN CAST(substr(drug_name, 7) AS INTEGER) % 4 = 2
              THEN regexp_replace(label_text, 'Reports of (\w+) (\w+) were', 'Reports of \2, \1 were', 'g') ELSE label_text END AS label_text
       FROM label_cache WHERE label_text <> ''),
rn AS (SELECT phrase, pt_code, max(kind) AS kind FROM (
         SELECT {_NORM.format("name")} AS phrase, term_id AS pt_code, 'pt' AS kind FROM tn JOIN tl USING (term_id) WHERE level = 'PT'
         UNION ALL SELECT {_NORM.format("n.name")}, e.parent_id, 'llt' FROM tn n JOIN tl l USING (term_id) JOIN edges e ON e.child_id = n.term_id
                   JOIN tl p ON p.term_id = e.parent_id AND p.level = 'PT' WHERE l.level = 'LLT'
         UNION ALL SELECT {_NORM.format("name")}, parent_id, 'llt' FROM flip) WHERE phrase <> '' GROUP BY 1, 2),
rs AS (SELECT drug_name, unnest({_SENTENCES}) AS part, unnest(range(len({_SENTENCES}))) AS s FROM rl),
mt AS (SELECT drug_name, pt_code, kind, phrase, min(s) AS sentence FROM rs JOIN rn ON contains(' ' || {_NORM.format("part")} || ' ', ' ' || phrase || ' ')
       GROUP BY 1, 2, 3, 4)"""
_CODED2 = CASES_CTE.split("case_in0 AS")[0].rstrip().rstrip(",")
ORACLE["label_mentions"] = ("WITH " + CLEAN_CTE + "," + DICT_CTE + "," + LABEL_CTE + _RELATED_CTE
                            + "\nSELECT drug_name, pt_code, kind, phrase, CAST(sentence AS INTEGER) AS sentence FROM mt")
ORACLE["label_related"] = "WITH " + CLEAN_CTE + "," + DICT_CTE + "," + LABEL_CTE + _CODED2 + _RELATED_CTE + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drug_name, pt_code ORDER BY kind <> 'pt', sentence, phrase) AS r FROM mt) WHERE r = 1)
SELECT c.id, c.drug_name, c.reaction_pt, c.m_pt_code AS meddra_pt_code,
  CASE WHEN b.phrase IS NOT NULL THEN 'Expected' WHEN rl.drug_name IS NOT NULL THEN 'Unexpected' END AS labelling_status,
  CASE b.kind WHEN 'pt' THEN 'direct' WHEN 'llt' THEN 'related' END AS match_kind, b.phrase AS matched_phrase,
  CASE WHEN b.phrase IS NOT NULL THEN rs.part
       WHEN rl.drug_name IS NOT NULL THEN '''' || c.reaction_pt || ''' is not mentioned in the label text.' ELSE '' END AS labelling_evidence
FROM coded2 c LEFT JOIN rl ON rl.drug_name = c.drug_name LEFT JOIN b ON b.drug_name = c.drug_name AND b.pt_code = c.m_pt_code
LEFT JOIN rs ON rs.drug_name = b.drug_name AND rs.s = b.sentence"""
ORACLE["label_class_rule"] = with_cases("""SELECT id, drug_name, m_soc AS meddra_soc, n_same, n_others, labelling_status, labelling_evidence, needs_review
FROM case_in2 WHERE label_source = 'llm_knowledge'""")
_ANSWERS = """, ao AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN 'Possibly' ELSE coalesce(labelling_status, 'Unknown') END AS st,
  replace(labelling_evidence, chr(34), '') AS ev FROM labelled),
aa AS (SELECT id, CAST(id AS BIGINT) % 6 NOT IN (3, 4) AS parse_ok, st, ev FROM ao),
ab AS (SELECT id, parse_ok, CASE WHEN parse_ok THEN st END AS labelling_status, CASE WHEN parse_ok THEN ev END AS labelling_evidence,
  CASE WHEN NOT parse_ok THEN 'unparsed' WHEN st NOT IN ('Expected', 'Unexpected') THEN 'bad_status' END AS reject_reason FROM aa)
"""
ORACLE["label_acceptance"] = with_labels(_ANSWERS + "SELECT * FROM ab")
ORACLE["label_acceptance_counts"] = with_labels(_ANSWERS + "SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM ab GROUP BY 1")


# ------------------------------------------------------- dictionary versions ----
def _adjective(c="name"):
    return F.split(c, " ")[0]


NEXT_ADJECTIVE = {"small": "red", "red": "blue", "hot": "cold", "cold": "hot"}  # fixture: a chain of two steps and a cycle


def dictionary_versions(spark, sf):
    """The lookup as one version, and a later one made from it: replaced, removed, renamed, moved and added codes."""
    old = staged(catalog.lookup_table(spark, sf).select(F.col("meddra_pt_code").alias("code"), F.col("meddra_pt").alias("name"),
                                                        F.col("meddra_soc_code").alias("soc")), "version")
    gone = _adjective().isin(*NEXT_ADJECTIVE, "large")
    kept = old.where(~gone).select(
        "code", F.when(_adjective() == "new", F.concat(F.lit("newer "), F.split("name", " ")[1])).otherwise(F.col("name")).alias("name"),
        F.when(F.col("name").endswith(" gear"), F.col("soc") + 1).otherwise(F.col("soc")).alias("soc"))
    added = old.where(F.col("name").endswith(" ring")).select((F.col("code") + 50_000_000).alias("code"), F.concat("name", F.lit(" acute")).alias("name"), "soc")
    step = F.coalesce(*[F.when(_adjective() == a, F.lit(b)) for a, b in NEXT_ADJECTIVE.items()])
    to = old.select(F.col("code").alias("new_code"), F.col("name").alias("to_name"))
    replaced = old.withColumn("to_name", F.concat(step, F.lit(" "), F.split("name", " ")[1])).join(to, "to_name").select("code", "new_code")
    return old, kept.unionByName(added), replaced


def audited(spark, sf):
    clean = staged(catalog.clean_reports(spark, sf).select("id", "reaction_pt"), "clean")
    coded = staged(C.drop_unmatched(C.code_terms(clean, catalog.lookup_table(spark, sf), scorer="levenshtein")), "coded")
    return AU.audit(*dictionary_versions(spark, sf), coded, "meddra_pt_code"), coded


@query("dict_audit")
def dict_audit(spark, sf):
    """Two versions of the dictionary compared, replaced codes followed to their end, records touched."""
    return audited(spark, sf)[0]


@query("dict_recode")
def dict_recode(spark, sf):
    """Coded reports with the code that the later version has for theirs."""
    table, coded = audited(spark, sf)
    return AU.recode(coded, "meddra_pt_code", staged(table, "audit")).select("id", "meddra_pt_code", "new_code")


_VERSIONS_CTE = """
, v1 AS (SELECT meddra_pt_code AS code, meddra_pt AS name, meddra_soc_code AS soc FROM lookup),
v2 AS (
  SELECT code, CASE WHEN name LIKE 'new %' THEN 'newer ' || split_part(name, ' ', 2) ELSE name END AS name,
    CASE WHEN name LIKE '% gear' THEN soc + 1 ELSE soc END AS soc FROM v1 WHERE split_part(name, ' ', 1) NOT IN ('small', 'red', 'hot', 'cold', 'large')
  UNION ALL SELECT code + 50000000, name || ' acute', soc FROM v1 WHERE name LIKE '% ring'),
rp AS (SELECT a.code, b.code AS new_code FROM v1 a JOIN v1 b ON b.name = CASE split_part(a.name, ' ', 1) WHEN 'small' THEN 'red' WHEN 'red' THEN 'blue'
         WHEN 'hot' THEN 'cold' WHEN 'cold' THEN 'hot' END || ' ' || split_part(a.name, ' ', 2)),
fw AS (SELECT code, new_code AS nxt, 1 AS hops FROM rp UNION ALL SELECT fw.code, rp.new_code, hops + 1 FROM fw JOIN rp ON rp.code = fw.nxt WHERE hops < 10),
fe AS (SELECT code, arg_max(nxt, hops) AS final_code, max(hops) AS hops FROM fw GROUP BY code),
nr AS (SELECT m_pt_code AS code, count(*) AS n FROM coded2 GROUP BY 1),
au AS (
  SELECT coalesce(a.code, b.code) AS code,
    CASE WHEN a.code IS NULL THEN 'added' WHEN b.code IS NULL THEN 'removed'
         WHEN a.name IS DISTINCT FROM b.name AND a.soc IS DISTINCT FROM b.soc THEN 'renamed+moved'
         WHEN a.name IS DISTINCT FROM b.name THEN 'renamed' WHEN a.soc IS DISTINCT FROM b.soc THEN 'moved' ELSE 'unchanged' END AS change,
    a.name AS old_name, b.name AS new_name, a.soc AS old_soc, b.soc AS new_soc,
    CASE WHEN e.hops < 10 THEN final_code END AS final_code, CASE WHEN e.hops < 10 THEN CAST(e.hops AS BIGINT) END AS hops, coalesce(e.hops = 10, false) AS in_cycle
  FROM v1 a FULL JOIN v2 b ON a.code = b.code LEFT JOIN fe e ON e.code = coalesce(a.code, b.code)),
av AS (SELECT au.*, CASE WHEN final_code IS NOT NULL THEN final_code IN (SELECT code FROM v2) END AS final_exists, coalesce(n, 0) AS n_records
       FROM au LEFT JOIN nr ON nr.code = au.code)
"""
_WITH_VERSIONS = "WITH RECURSIVE " + CLEAN_CTE + "," + DICT_CTE + _CODED2 + _VERSIONS_CTE
ORACLE["dict_audit"] = _WITH_VERSIONS + "SELECT * FROM av"
ORACLE["dict_recode"] = _WITH_VERSIONS + """SELECT id, m_pt_code AS meddra_pt_code, CASE WHEN change = 'removed' AND final_exists THEN final_code ELSE m_pt_code END AS new_code
FROM coded2 JOIN av ON av.code = m_pt_code"""


# ------------------------------------------------------------------ drug names ----
#: Fixture: a brand as it is reported, in six spellings, and the synonym sheet that joins them.
REPORTED = """CASE l_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) || ' 10 mg' WHEN 2 THEN p_brand || ' Hydrochloride (tablets)'
  WHEN 3 THEN 'gen-' || substr(p_brand, 7) || ' 5 mg/ml oral solution' WHEN 4 THEN 'code-' || substr(p_brand, 7) || ' sodium phosphate'
  ELSE '  ' || p_brand || ', 2.5 % cream' END"""


def reported_drugs(spark, sf):
    """(report_key, name, p_brand): every order line's drug as reported."""
    lines = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    part = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("report_key"), F.expr(REPORTED).alias("name"), "p_brand")


def synonym_sheet(spark, sf):
    """Brand to generic, generic to code; every fifth code is also the next brand's."""
    b = read_table(spark, sf, "part", "p_brand").distinct().select("p_brand", F.substring("p_brand", 7, 9).cast("int").alias("b"))
    gen, code = F.concat(F.lit("gen-"), F.col("b")), F.concat(F.lit("code-"), F.col("b"))
    return (b.select(F.col("p_brand").alias("a"), gen.alias("b")).unionByName(b.select(gen.alias("a"), code.alias("b")))
            .unionByName(b.where("b % 5 = 0").select(code.alias("a"), F.concat(F.lit("BRAND#"), F.col("b") + 1).alias("b"))))


@query("drug_canonical")
def drug_canonical(spark, sf):
    return DN.canonical_names(reported_drugs(spark, sf), synonym_sheet(spark, sf))


@query("drug_label_coverage")
def drug_label_coverage(spark, sf):
    """Reported lines whose drug has label text: by the name as reported, and by the canonical name."""
    drugs = staged(reported_drugs(spark, sf), "drugs")
    known = staged(DN.canonical_names(drugs.select("name").unionByName(drugs.select(F.col("p_brand").alias("name"))), synonym_sheet(spark, sf)), "canonical")
    brands = drugs.select(F.col("p_brand").alias("drug_name")).distinct()
    labelled = staged(L.label_cascade(brands, bridge.label_rows(spark, sf)), "labels").where("label_text <> ''").select(F.col("drug_name").alias("name"))
    names = drugs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    by_name = labelled.select("name", F.lit(True).alias("exact"))
    by_canonical = known.join(labelled, "name").select("canonical", F.lit(True).alias("joined")).distinct()
    x = names.join(known, "name").join(by_name, "name", "left").join(by_canonical, "canonical", "left")
    return x.agg(F.sum("n").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("exact"), F.col("n"))), F.lit(0)).alias("n_exact"),
                 F.coalesce(F.sum(F.when(F.col("joined"), F.col("n"))), F.lit(0)).alias("n_canonical"))


def _base_sql(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    x = low
    for pattern, by in DN.PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '{DN.SALT}', '\\1 ', 'g'), '^ | $', '', 'g')"
    return f"coalesce(nullif({x}, ''), trim({low}))"


_DRUG_CTE = f"""WITH RECURSIVE rd AS (SELECT l_orderkey AS report_key, {REPORTED} AS name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
bn AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part),
sy AS (SELECT p_brand AS a, 'gen-' || b AS b FROM bn UNION ALL SELECT 'gen-' || b, 'code-' || b FROM bn UNION ALL SELECT 'code-' || b, 'BRAND#' || (b + 1) FROM bn WHERE b % 5 = 0),
ed AS (SELECT {_base_sql("a")} AS u, {_base_sql("b")} AS v FROM sy),
e2 AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
cc AS (SELECT u, u AS r FROM e2 UNION SELECT cc.u, e2.v FROM cc JOIN e2 ON cc.r = e2.u),
cm AS (SELECT u, min(r) AS component FROM cc GROUP BY u),
kn AS (SELECT name, {_base_sql("name")} AS base FROM (SELECT name FROM rd UNION SELECT p_brand FROM rd)),
kc AS (SELECT kn.name, kn.base, coalesce(component, base) AS canonical FROM kn LEFT JOIN cm ON cm.u = kn.base)
"""
ORACLE["drug_canonical"] = _DRUG_CTE + "SELECT * FROM kc WHERE name IN (SELECT name FROM rd)"
ORACLE["drug_label_coverage"] = _DRUG_CTE.rstrip() + "," + LABEL_CTE.split("drugs AS (")[0].rstrip().rstrip(",") + """,
lb AS (SELECT drug_name FROM besthit WHERE label_text <> '' AND drug_name IN (SELECT p_brand FROM rd)),
lc AS (SELECT DISTINCT canonical FROM kc JOIN lb ON lb.drug_name = kc.name)
SELECT count(*) AS n_lines, count(*) FILTER (rd.name IN (SELECT drug_name FROM lb)) AS n_exact,
  count(*) FILTER (kc.canonical IN (SELECT canonical FROM lc)) AS n_canonical FROM rd JOIN kc ON kc.name = rd.name"""


# ----------------------------------------------------------- confidence routing ----
#: Fixture: a confidence that is higher for right answers, and missing for some.
CONFIDENCE = "CAST(CASE WHEN index % 37 = 0 THEN NULL WHEN ok THEN 350 + index % 600 ELSE 50 + index % 700 END AS DOUBLE) / 1000"


def confident(spark, sf):
    # staged: a filter on what the parser found would be computed beside the columns it gives
    s = staged(catalog.scored(spark, sf).select("index", "parse_ok", F.col("seriousness.match").alias("ok")), "scored")
    return s.where("parse_ok").select("index", "ok").withColumn("confidence", F.expr(CONFIDENCE))


@query("risk_coverage")
def risk_coverage(spark, sf):
    return EV.risk_coverage(confident(spark, sf), "confidence", "ok", 100)


@query("route_by_confidence")
def route_by_confidence(spark, sf):
    """Answers that need no reviewer if one in five of them may be wrong."""
    return EV.route(confident(spark, sf), "confidence", "ok", 20, 100).select("index", "confidence", "route")


_CONF_CTE = "WITH " + _with_scored("base") + f""",
cf AS (SELECT index, ok, {CONFIDENCE} AS confidence FROM (SELECT index, seriousness_match AS ok FROM s WHERE parse_ok)),
bk AS (SELECT CASE WHEN confidence IS NOT NULL THEN CAST(least(floor(confidence * 100), 99) AS BIGINT) END AS bucket, count(*) AS n, count(*) FILTER (NOT coalesce(ok, false)) AS errors FROM cf GROUP BY 1),
cu AS (SELECT *, sum(n) OVER (ORDER BY bucket DESC NULLS LAST)::BIGINT AS covered, sum(errors) OVER (ORDER BY bucket DESC NULLS LAST)::BIGINT AS wrong, sum(n) OVER () AS total FROM bk)
"""
ORACLE["risk_coverage"] = _CONF_CTE + "SELECT bucket, n, errors, covered, wrong, covered / total AS coverage, wrong / covered AS risk FROM cu WHERE bucket IS NOT NULL"
ORACLE["route_by_confidence"] = _CONF_CTE + """SELECT index, confidence,
  CASE WHEN confidence IS NOT NULL AND least(floor(confidence * 100), 99) >= (SELECT min(bucket) FROM cu WHERE bucket IS NOT NULL AND wrong * 100 <= covered * 20) THEN 'auto' ELSE 'review' END AS route FROM cf"""
