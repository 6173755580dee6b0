"""Facts and risk tags of contracts. The texts are composed from ``orders`` and ``lineitem`` by one SELECT that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import catalogues, clause_rules
from sedge.functions.rules import RuleSet
from sedge.operators import facts, risks
from sedge.plans.base import over, query, t

_AMOUNT = "CAST(CAST(floor({}) AS BIGINT) AS STRING)"
TEXTS = f"""
li AS (SELECT l_orderkey, count(*) AS n, CAST(floor(sum(l_quantity)) AS BIGINT) AS qty, max(l_linenumber) AS most FROM lineitem GROUP BY l_orderkey),
contracts AS (SELECT o_orderkey AS doc_id, o_custkey,
  'LEASE AGREEMENT' || chr(10)
  || 'Acme Holdings' || CAST(o_custkey AS STRING) || ' LLC ("Landlord") and ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Beta Stores Inc. (the "Tenant")' ELSE 'others' END || chr(10)
  || CASE WHEN o_orderkey % 2 = 1 THEN 'Tenant: Gamma & Sons' || chr(10) ELSE '' END
  || 'Premises: ' || CAST(o_orderkey AS STRING) || ' Main Street, Unit ' || CAST(n AS STRING) || chr(10)
  || 'The term shall be ' || CAST(most + 1 AS STRING) || ' years. The term commences on ' || CAST(CAST(o_orderdate AS DATE) AS STRING)
  || ' and expires on ' || CAST(1 + o_orderkey % 12 AS STRING) || '/' || CAST(1 + o_orderkey % 28 AS STRING) || '/' || CASE WHEN o_orderkey % 3 = 0 THEN '31' ELSE '2031' END || '.' || chr(10)
  || 'The base rent is ${{}}' || CASE o_orderkey % 4 WHEN 0 THEN ' per month' WHEN 1 THEN ' annually' WHEN 2 THEN ' per square foot' ELSE '' END || ', increasing by ' || CAST(1 + o_orderkey % 5 AS STRING)
  || '.5% ' || CASE WHEN o_orderkey % 3 = 0 THEN 'each year' ELSE 'by the Consumer Price Index' END || '. Tenant has ' || CAST(o_orderkey % 6 AS STRING) || ' months of free rent.' || chr(10)
  || CASE WHEN o_orderkey % 3 < 2 THEN 'Percentage rent is 6% of gross sales over $' || CAST(qty * 1000 AS STRING) || ' and 4.5% of gross sales in excess of $' || CAST(qty * 2500 AS STRING)
     || '; gross sales shall exclude returns, sales tax and gift cards.' || chr(10) ELSE '' END
  || 'This is a ' || CASE o_orderkey % 3 WHEN 0 THEN 'triple net' WHEN 1 THEN 'modified gross' ELSE 'full service' END || ' lease. The common area charge is $' || CAST(qty AS STRING) || '.50, shall not exceed a rise of '
  || CAST(3 + o_orderkey % 4 AS STRING) || '% and bears an administrative fee of ' || CAST(o_orderkey % 15 AS STRING) || '%. Landlord shall reconcile it annually.' || chr(10)
  || 'On default Landlord gives ' || CAST(5 + o_orderkey % 20 AS STRING) || ' days written notice; Tenant may cure within ' || CAST(10 + o_orderkey % 30 AS STRING) || ' business days.' || chr(10)
  || CASE WHEN o_orderkey % 4 = 0 THEN 'If Tenant fails to open, then Landlord may terminate. If the anchor leaves, then rent abates; co-tenancy applies unless waived.' || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 5 < 3 THEN 'Tenant has ' || CASE o_orderkey % 3 WHEN 0 THEN 'two' WHEN 1 THEN '3' ELSE 'one' END || ' renewal options. Each option runs for ' || CAST(1 + o_orderkey % 5 AS STRING)
     || ' years. Tenant holds a right of first ' || CASE WHEN o_orderkey % 2 = 0 THEN 'refusal' ELSE 'offer' END || '.' || chr(10) ELSE '' END
  || 'The security deposit is $' || CAST(100 + o_orderkey % 900 AS STRING) || '.00, used only for repairs of the premises.' || chr(10)
  || CASE o_orderkey % 7 WHEN 0 THEN 'Landlord may enter without notice in its sole discretion.' WHEN 1 THEN 'Tenant waives all claims and takes the premises as-is.' WHEN 2 THEN 'A late fee of ____ applies.'
     WHEN 3 THEN 'The lease shall automatically renew; [insert date].' WHEN 4 THEN 'Landlord may accelerate all rent on default.' WHEN 5 THEN 'The owner personally guarantees with unlimited liability.' ELSE 'Landlord may relocate the Tenant once.' END
  || chr(10) || CASE o_orderkey % 9 WHEN 0 THEN 'Tenant may assign without consent and sublet freely or transfer.' WHEN 1 THEN 'Tenant shall not assign the lease.' WHEN 2 THEN 'Tenant may terminate early.'
     WHEN 3 THEN 'Insurance: a waiver of subrogation binds Tenant.' WHEN 4 THEN 'Operating expenses are shared.' WHEN 5 THEN 'Hazardous matter: Tenant shall indemnify Landlord.'
     WHEN 6 THEN 'Environmental: Tenant is responsible for prior spills.' WHEN 7 THEN 'Landlord keeps property insurance; Tenant shall repair structural parts.' ELSE 'Use exclusively for retail; shopping center hours shall be kept.' END
  AS text FROM orders JOIN li ON l_orderkey = o_orderkey)""".replace("${}'", "$' || " + _AMOUNT.format("o_totalprice") + " || '.00'")


def contracts(spark, sf):
    """The rows that texts are composed from are dealt out first: a text is fifty times as long, and a small table comes in one part."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").repartition(parts, "o_orderkey")
    return over(spark, f"WITH {TEXTS} SELECT doc_id, o_custkey, text FROM contracts", orders=orders, lineitem=t(spark, sf, "lineitem"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CLEAN = "regexp_replace(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'), ' '), '[ ,.]+$', '')"


def facts_sql(rules) -> str:
    """WITH terms whose last, ``facts``, holds (doc_id, field, value, rule_id, ordinal, confidence) of a catalogue."""
    lists = []
    for i, r in enumerate(rules):
        values = f"list_filter(list_transform(regexp_extract_all(text, {_quoted(r.pattern)}, {r.group}), lambda v: {_CLEAN.format('v')}), lambda v: v <> '')"
        lists.append(f"list_transform({values}, lambda v, i: {{'field': '{r.field}', 'value': v, 'rule_id': {i}, 'ordinal': i - 1, 'confidence': {float(r.confidence)}::DOUBLE}})")
    return f"{TEXTS}, ff AS (SELECT doc_id, unnest(flatten([{', '.join(lists)}])) AS f FROM contracts), facts AS (SELECT doc_id, f.field AS field, f.value AS value, f.rule_id::INT AS rule_id, f.ordinal::INT AS ordinal, f.confidence AS confidence FROM ff)"


def found(spark, sf, name):
    return facts.extract_facts(contracts(spark, sf), catalogues.CATALOGUES[name], id="doc_id", text="text", least_chars=1)


COLUMNS = ["doc_id", "field", "value", "rule_id", "ordinal", "confidence"]
CATALOGUE_QUERIES = {"facts_rent": "rent", "facts_pct_rent": "percentage_rent", "facts_cam": "shared_costs", "facts_notice": "notice", "facts_conditional": "conditions", "facts_options": "options", "facts_party_terms": "parties"}


def _register(name: str, catalogue: str) -> None:
    @query(name, f"WITH {facts_sql(catalogues.CATALOGUES[catalogue])} SELECT {', '.join(COLUMNS)} FROM facts")
    def run(spark, sf):
        return found(spark, sf, catalogue).select(COLUMNS)

    run.__name__ = name


for _name, _catalogue in CATALOGUE_QUERIES.items():
    _register(_name, _catalogue)

_ISO = r"""CASE WHEN regexp_matches(value, '^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$') THEN
  CASE WHEN length(split_part(value, '/', 3)) = 2 THEN '20' || split_part(value, '/', 3) ELSE split_part(value, '/', 3) END || '-' || lpad(split_part(value, '/', 1), 2, '0') || '-' || lpad(split_part(value, '/', 2), 2, '0') ELSE value END"""


@query("facts_dates", f"WITH {facts_sql(catalogues.CRITICAL_DATES)} SELECT doc_id, field, {_ISO} AS value, rule_id, ordinal, confidence FROM facts")
def facts_dates(spark, sf):
    return found(spark, sf, "critical_dates").withColumn("value", facts.iso_date(F.col("value"))).select(COLUMNS)


def _pairs_sql(name: str) -> str:
    pattern = _quoted(catalogues.PAIRS[name])
    both = [f"list_transform(regexp_extract_all(text, {pattern}, {g}), lambda v: {_CLEAN.format('v')})" for g in (1, 2)]
    return f"SELECT doc_id, '{name}' AS kind, (i - 1)::INT AS ordinal, a[i] AS first, b[i] AS second FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {both[0]} AS a, {both[1]} AS b FROM contracts))"


@query("facts_pairs", f"WITH {TEXTS} " + " UNION ALL ".join(_pairs_sql(n) for n in catalogues.PAIRS))
def facts_pairs(spark, sf):
    """Percentages with their thresholds, conditions with their consequences, notice periods with their units, escalations with their frequency."""
    found = facts.extract_pair_kinds(contracts(spark, sf), catalogues.PAIRS, id="doc_id", text="text", words=catalogues.PAIR_WORDS)
    return found.select("doc_id", "kind", "ordinal", "first", "second")


@query("facts_option_rows", f"""WITH {facts_sql(catalogues.OPTIONS)}, n AS (SELECT doc_id, arg_min(value, (rule_id, ordinal)) FILTER (field = 'renewal_options') AS n, arg_min(value, (rule_id, ordinal)) FILTER (field = 'option_term') AS term FROM facts GROUP BY 1),
k AS (SELECT doc_id, term, CASE lower(n) WHEN 'one' THEN 1 WHEN 'two' THEN 2 ELSE try_cast(n AS INT) END AS k FROM n) SELECT doc_id, unnest(range(1, k + 1))::INT AS option_no, term FROM k WHERE k BETWEEN 1 AND 100""")
def facts_option_rows(spark, sf):
    return facts.option_rows(found(spark, sf, "options"), id="doc_id")


@query("facts_exclusions", f"""WITH {facts_sql(catalogues.PERCENTAGE_RENT)}, x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(value, ',\\s*and\\s+|\\s+and\\s+|[,;]'), lambda v: trim(v)), lambda v: v <> '') AS v FROM facts WHERE field = 'exclusions')
SELECT doc_id, 'exclusions' AS field, (i - 1)::INT AS item_no, v[i] AS item FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM x)""")
def facts_exclusions(spark, sf):
    return facts.list_items(found(spark, sf, "percentage_rent"), id="doc_id", field="exclusions")


_TAGS = " UNION ALL ".join(f"SELECT doc_id, '{tag}' AS tag, '{level}' AS level FROM contracts WHERE regexp_matches(text, {_quoted(p)})" for tag, level, p in catalogues.RISK_TAGS)


@query("pattern_risk_tags", f"WITH {TEXTS} {_TAGS}")
def pattern_risk_tags(spark, sf):
    return risks.pattern_tags(contracts(spark, sf), catalogues.RISK_TAGS, id="doc_id", texts=["text"])


#: Clauses are the lines of a contract; a line's key comes from its words.
CLAUSES = """clauses AS (SELECT doc_id, line_no, line, CASE WHEN lower(line) LIKE '%assign%' THEN 'assignment' WHEN lower(line) LIKE '%insurance%' AND lower(line) LIKE '%repair%' THEN 'insurance_and_repair' WHEN lower(line) LIKE '%insurance%' THEN 'insurance'
  WHEN lower(line) LIKE '%accelerate%' OR lower(line) LIKE '%default%' THEN 'default' WHEN lower(line) LIKE '%base rent%' THEN 'base_rent' WHEN lower(line) LIKE '%term%' THEN 'term' WHEN lower(line) LIKE '%used%' OR lower(line) LIKE '%use %' THEN 'permitted_use'
  WHEN lower(line) LIKE '%expenses%' THEN 'operating_expenses' ELSE 'other' END AS clause_key, CASE doc_id % 4 WHEN 0 THEN 'retail' WHEN 1 THEN 'office' WHEN 2 THEN 'industrial' ELSE 'other' END AS kind FROM lined)"""
CLAUSES_SQL = f"{TEXTS}, lined AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM contracts))), {CLAUSES}, low AS (SELECT doc_id, line_no, kind, lower(clause_key || chr(10) || line) AS x FROM clauses)"


def clauses(spark, sf):
    from sedge.operators import segment

    # A line is put into lower case once for all tests of it.
    lined = segment.lines(contracts(spark, sf)).select("doc_id", "line_no", "line", F.lower("line").alias("low"))
    return over(spark, f"WITH {CLAUSES.replace('lower(line)', 'low')} SELECT * FROM clauses", lined=lined)


def _rule_sql(kind: str, rule) -> str:
    tests = [f"regexp_matches(x, {_quoted(rule.pattern)})"] + ([f"regexp_matches(x, {_quoted(rule.gate)})"] if rule.gate else []) + ([f"NOT regexp_matches(x, {_quoted(rule.unless)})"] if rule.unless else [])
    where = "" if kind == "all" else f"kind = '{kind}' AND "
    return f"SELECT doc_id, line_no::INT AS line_no, '{rule.name}' AS rule, '{rule.level}' AS level FROM low WHERE {where}{' AND '.join(tests)}"


@query("contract_risks", f"WITH {CLAUSES_SQL} " + " UNION ALL ".join(_rule_sql(kind, r) for kind, rules in clause_rules.CLAUSE_RISKS.items() for r in rules))
def contract_risks(spark, sf):
    """The built-in rules: those of all contracts and those of a contract's type."""
    rows = clauses(spark, sf)
    text = clause_rules.clause_text(F.col("clause_key"), F.col("line"))
    rules = {kind: RuleSet(rules) for kind, rules in clause_rules.CLAUSE_RISKS.items()}
    found = risks.all_risks(rows, rules.pop("all"), rules, kind="kind", text=text, keep=["doc_id", "line_no"])
    return found.select("doc_id", "line_no", "rule", "level")


def _side_sql(gate: str, pattern: str) -> str:
    return f"min(line_no) FILTER (regexp_matches(x, {_quoted(gate)}) AND regexp_matches(x, {_quoted(pattern)}))"


@query("contract_paired_risks", f"WITH {CLAUSES_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, '{level}' AS level, {_side_sql(*a)}::INT AS first_a, {_side_sql(*b)}::INT AS first_b FROM low GROUP BY doc_id HAVING first_a IS NOT NULL AND first_b IS NOT NULL" for name, level, a, b in clause_rules.PAIRED_RISKS))
def contract_paired_risks(spark, sf):
    rows = clauses(spark, sf).withColumn("_x", clause_rules.clause_text(F.col("clause_key"), F.col("line")))
    side = lambda s: F.col("_x").rlike(s[0]) & F.col("_x").rlike(s[1])
    out = None
    for name, level, a, b in clause_rules.PAIRED_RISKS:
        found = risks.paired_risks(rows, doc="doc_id", order="line_no", a=side(a), b=side(b)).select("doc_id", F.lit(name).alias("rule"), F.lit(level).alias("level"), "first_a", "first_b")
        out = found if out is None else out.unionByName(found)
    return out


_KINDS = "CASE WHEN doc_id % 2 = 0 THEN 'retail' ELSE kind END"


def _absence_sql(kind: str, name: str, level: str, though: tuple[str, str], never: str) -> str:
    tests = f"bool_or(regexp_matches(x, {_quoted(though[0])}) AND regexp_matches(x, {_quoted(though[1])})) AND NOT bool_or(regexp_matches(x, {_quoted(never)}))"
    return f"SELECT doc_id, '{name}' AS rule, '{level}' AS level FROM low WHERE {_KINDS} = '{kind}' GROUP BY doc_id HAVING {tests}"


@query("contract_absences", f"WITH {CLAUSES_SQL} " + " UNION ALL ".join(_absence_sql(*r) for r in clause_rules.ABSENCE_RISKS))
def contract_absences(spark, sf):
    """The built-in rules on what a document of a type should say and does not."""
    rows = clauses(spark, sf).withColumn("kind", F.expr(_KINDS)).withColumn("_x", clause_rules.clause_text(F.col("clause_key"), F.col("line")))
    out = None
    for kind, name, level, though, never in clause_rules.ABSENCE_RISKS:
        found = risks.absence(rows.filter(F.col("kind") == kind), doc="doc_id", never=F.col("_x").rlike(never), though=F.col("_x").rlike(though[0]) & F.col("_x").rlike(though[1]))
        found = found.select("doc_id", F.lit(name).alias("rule"), F.lit(level).alias("level"))
        out = found if out is None else out.unionByName(found)
    return out


#: What every contract, and a contract of a type, should speak of: type, category, words.
ESSENTIAL = (
    (None, "deposit", ("deposit", "bond")), (None, "assignment", ("subletting", "handed on")), (None, "termination", ("terminat", "cancel")), (None, "insurance", ("insurance", "insured")),
    ("retail", "co_tenancy", ("co-tenancy",)), ("retail", "opening_hours", ("opening hours", "center hours")), ("office", "operating_expenses", ("operating expenses", "running costs")), ("industrial", "environmental", ("environmental", "spill")),
)


def _there_sql(category: str, words) -> str:
    stem = "regexp_replace(lower(clause_key), '_data|_clause|_inferred', '', 'g')"
    return f"bool_or({stem} IN ({', '.join(_quoted(w) for w in (category, *words))}) OR " + " OR ".join(f"contains(lower(clause_key), {_quoted(w)}) OR contains(lower(line), {_quoted(w)})" for w in words) + ")"


@query("contract_missing", f"WITH {CLAUSES_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category FROM clauses WHERE {f'kind = {_quoted(kind)}' if kind else 'true'} GROUP BY doc_id HAVING NOT {_there_sql(c, words)}" for kind, c, words in ESSENTIAL))
def contract_missing(spark, sf):
    """Categories that neither a clause's key nor any text of the contract speaks of."""
    rows = spark.createDataFrame([(kind, c, w) for kind, c, words in ESSENTIAL for w in words], "kind string, category string, keyword string")
    return risks.missing_by_words(clauses(spark, sf), rows, doc="doc_id", key="clause_key", texts=["line"], kind="kind")


def _sections_sql() -> str:
    first = lambda rows: "CASE " + " ".join(f"WHEN regexp_matches(lower(line), {_quoted(p)}) THEN '{g}'" for g, p in rows) + " END"
    kinds = " ".join(f"WHEN '{kind}' THEN {first((*rows, *catalogues.SECTIONS))}" for kind, rows in catalogues.SECTIONS_OF.items())
    return f"""WITH {CLAUSES_SQL}, g AS (SELECT doc_id, line_no, line, CASE kind {kinds} ELSE {first(catalogues.SECTIONS)} END AS g FROM clauses),
r AS (SELECT *, sum((g IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM g)
SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(g), 'preamble') AS section, sum(length(regexp_replace(line, '[ \\t\\r\\n]', '', 'g')))::BIGINT AS n_solid, count(*) AS n_lines FROM r GROUP BY doc_id, section_no"""


@query("contract_sections", _sections_sql())
def contract_sections(spark, sf):
    """Sections by the built-in groups, those of a contract's type first."""
    from sedge.functions.rules import Rule
    from sedge.operators import segment

    kind = F.when(F.col("doc_id") % 4 == 0, "retail").when(F.col("doc_id") % 4 == 1, "office").when(F.col("doc_id") % 4 == 2, "industrial").otherwise("other")
    texts, out = contracts(spark, sf).withColumn("kind", kind), None
    for name, own in (*catalogues.SECTIONS_OF.items(), ("other", ())):
        rules = RuleSet(Rule(group, pattern) for group, pattern in (*own, *catalogues.SECTIONS))
        found = segment.pattern_sections(texts.filter(F.col("kind") == name), rules)
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", "section_no", "section", "n_solid", "n_lines")
