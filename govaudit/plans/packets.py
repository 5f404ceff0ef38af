"""Queries over launch packets: scan, lookup, audit, text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions import actions as act
from govaudit.functions.sqltext import bind
from govaudit.functions.text import asserted_occurrences, occurrences
from govaudit.operators import audit, grade, phrase_index, rescan, scan
from govaudit.operators.rules import REGISTRY, phrase_rule, with_rule
from govaudit.plans import sql
from govaudit.plans.registry import query
from govaudit.plans.sql import CODES, q, qlist
from govaudit.session import new_path, written
from govaudit.sources import bridge, lookup, packets as packet_source

SEVERITY_SQL = sql.severity("code")


def joined(column: str):
    return F.array_join(column, ",").alias(column)


# --- packet scan -------------------------------------------------------------

@query(sql.query(f"""
  SELECT sector, {SEVERITY_SQL} AS severity, code, CAST(count(*) AS BIGINT) AS n_violations
  FROM (SELECT sector, unnest(detected) AS code FROM scan) GROUP BY ALL""", "scan"))
def violations_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.violations(bridge.packets(spark, sf_dir))
    return (found.groupBy("sector", cat.severity_of(F.col("code")).alias("severity"), "code")
            .agg(F.count(F.lit(1)).alias("n_violations")))


@query(sql.query(sql.checks("scan"), "scan"))
def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (scan.all_checks(bridge.packets(spark, sf_dir))
            .select("packet_id", "ord", "code", "passed", "message"))


@query(sql.query(f"""
  SELECT *, code = 'AUDIT-007' OR (code = 'EVAL-008' AND packet_id % 100 = 7) AS evaluated FROM ({sql.checks("scan")})""", "scan"))
def rescanned_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets scanned again after one in a hundred got another evaluation report and the registry one more rule."""
    packets = bridge.packets(spark, sf_dir)
    earlier = packets.withColumn("artifacts", F.when(F.col("packet_id") % 100 == 7, F.col("artifacts").withField(
        "`eval_report.json`", F.lit("to come"))).otherwise(F.col("artifacts")))
    fewer = {code: rule for code, rule in REGISTRY.items() if code != "AUDIT-007"}
    empty = spark.createDataFrame([], "packet_id BIGINT, digest BINARY, message STRING")
    before = written(rescan.rescan(earlier, empty, fewer), "verdicts-before")
    return rescan.rescan(packets, before).drop("digest")


@query(sql.query("SELECT packet_id, array_to_string(detected, ',') AS detected, CAST(len(detected) AS BIGINT) AS n_detected,"
                 " detected = truth AS as_declared FROM scan", "scan"))
def violation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan.scan(bridge.packets(spark, sf_dir))
    return scanned.select("packet_id", joined("detected"), F.size("detected").cast("bigint").alias("n_detected"),
                          (F.col("detected") == F.col("truth")).alias("as_declared"))


_FIRST = "CASE " + " ".join(f"WHEN m{i} IS NOT NULL THEN {q(c)}" for i, c in enumerate(cat.CODES)) + " END"
_NOTE = "coalesce(" + ", ".join(f"m{i}" for i in range(len(cat.CODES))) + ")"


@query(sql.query(f"""
  SELECT packet_id, first_code, CASE WHEN first_code IS NULL THEN NULL ELSE {sql.severity('first_code', 'high')} END
    AS first_severity, {sql.case_map('first_code', cat.ARTIFACT_OF, 'NULL')} AS first_artifact, left({_NOTE}, 120) AS first_note
  FROM (SELECT *, {_FIRST} AS first_code FROM scan)""", "scan"))
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (scan.first_failure(bridge.packets(spark, sf_dir))
            .select("packet_id", "first_code", "first_severity", "first_artifact", "first_note"))


@query(sql.query(f"""
  SELECT sector, severity, code, CAST(count(*) AS BIGINT) AS n_violations
  FROM (SELECT sector, code, {SEVERITY_SQL} AS severity FROM (SELECT sector, unnest(detected) AS code FROM scan))
  GROUP BY ROLLUP (sector, severity, code)""", "scan"))
def violation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.violation_rollup(bridge.packets(spark, sf_dir))


_CONSOLE = sql.asserted_count("lower(product_spec_md)", "console", ["no", "without"])


@query(sql.query(f"""
  SELECT code, CAST(count(*) AS BIGINT) AS n_packets FROM (
    SELECT unnest(list_concat(detected, CASE WHEN {_CONSOLE} > 0 THEN ['CONSOLE-900'] ELSE {sql.NONE} END)) AS code
    FROM scan) GROUP BY 1""", "scan"))
def custom_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = with_rule("CONSOLE-900", phrase_rule(
        "product_spec.md", "console", "CONSOLE-900: a console is offered", ["no", "without"]))
    found = scan.violations(bridge.packets(spark, sf_dir), registry)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n_packets"))


# --- packet sources ----------------------------------------------------------

@query(sql.query("""
  SELECT o_orderkey AS request_id, coalesce(p.packet_id, 0) AS loaded_id,
    coalesce(p.feature_name, d.feature_name) AS feature_name,
    coalesce(p.expected_decision, d.expected_decision) AS expected_decision
  FROM orders LEFT JOIN packets p ON p.packet_id = o_orderkey
  CROSS JOIN (SELECT * FROM packets WHERE packet_id = 0) d""", "packets"))
def packet_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"))
    known = bridge.packets(spark, sf_dir).select("packet_id", "feature_name", "expected_decision")
    return (packet_source.load_by_id(wanted, known, fallback_id=0)
            .withColumnRenamed("packet_id", "request_id"))


LOOKED_UP = 100


@query(sql.query(f"""
  SELECT packet_id, feature_name, expected_decision, retention_policy_yaml AS retention FROM packets WHERE packet_id IN (
    SELECT o_custkey FROM (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1) ORDER BY most DESC, o_custkey LIMIT {LOOKED_UP})""",
    "packets"))
def packets_of_largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of the packets of the customers with the largest orders, one artifact each."""
    every = bridge.packets(spark, sf_dir)
    path = new_path(spark, "packets-by-id")
    lookup.write_for_lookup(every, path)
    most = bridge.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    ids = [r.o_custkey for r in most.orderBy(F.desc("most"), "o_custkey").limit(LOOKED_UP).collect()]
    found = lookup.look_up(spark, path, every.schema, ids)
    return found.select("packet_id", "feature_name", "expected_decision", F.col("artifacts").getField("retention_policy.yaml").alias("retention"))


_TEMPLATE_TEXTS = ", ".join(
    f"{sql.patched_text(a, sql.template_text(a, 'domain', 'title'), 'truth')} AS {sql.col_of(a)}" for a in cat.ARTIFACTS)
# Template packets: one per part, with the codes of its key planted by patches.
TEMPLATE_SQL = f"""
  SELECT *, {_TEMPLATE_TEXTS} FROM (
    SELECT p_partkey AS packet_id, {sql.codes_of_mask('p_partkey')} AS truth, lower(p_type) AS domain,
      upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title FROM part)"""
TEMPLATE_BLOCKS = {"template": TEMPLATE_SQL, "tscan": sql.scanned("template")}


@query(sql.query(f"""
  SELECT packet_id, source, domain, expected_risk, expected_decision, CAST(len(truth) AS BIGINT) AS n_truth FROM (
    SELECT packet_id, NULL AS source, domain, expected_risk, expected_decision, truth FROM packets
    UNION ALL
    SELECT packet_id, 'generated', domain, {sql.risk_of('truth', 2)}, {sql.decision_of('truth')}, truth FROM template)
  """, "packets", extra={"template": TEMPLATE_SQL}))
def packet_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = packet_source.intake(bridge.packets(spark, sf_dir), bridge.template_packets(spark, sf_dir))
    return both.select("packet_id", "source", "domain", "expected_risk", "expected_decision",
                       F.size("truth").cast("bigint").alias("n_truth"))


@query(sql.query("""
  SELECT packet_id, artifact, content IS NOT NULL AS found, content FROM (
    SELECT packet_id, 'retention_policy.yaml' AS artifact, retention_policy_yaml AS content FROM packets
    UNION ALL SELECT packet_id, 'release_notes.txt', NULL FROM packets)""", "packets"))
def artifact_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = bridge.packets(spark, sf_dir)
    return (scan.artifact_content(packets, "retention_policy.yaml")
            .unionByName(scan.artifact_content(packets, "release_notes.txt")))


_LONG = " UNION ALL ".join(
    f"SELECT packet_id, {q(a)} AS artifact, {i} AS ord, {sql.col_of(a)} AS content FROM packets"
    for i, a in enumerate(cat.ARTIFACTS))


@query(sql.query("""
  SELECT packet_id, artifact,
    CASE WHEN (packet_id + ord) % 2 = 0 THEN CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END
    ELSE '[' || upper(string_split(artifact, '.')[-1]) || ' file — ' || length(content)
         || ' chars] Use inspect_artifact to view content.' END AS preview
  FROM long""", "packets", extra={"long": _LONG}))
def artifact_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scan.artifacts_long(bridge.packets(spark, sf_dir))
    position = F.array_position(F.array(*[F.lit(a) for a in cat.ARTIFACTS]), F.col("artifact")) - 1
    seen = (F.col("packet_id") + position) % 2 == 0
    return long.select("packet_id", "artifact", scan.preview(F.col("artifact"), F.col("content"), seen).alias("preview"))


# --- dimensions in use -------------------------------------------------------

_RULES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS ord, {q(c)} AS code, {q(n)} AS name, {q(d)} AS description, {q(s)} AS severity, {q(a)} AS artifact, "
    f"{q(cat.LOOK_FOR[c])} AS look_for" for i, (c, n, d, s, a) in enumerate(cat.RULES))
_SECTORS_SQL = " UNION ALL ".join(
    f"SELECT {q(k)} AS sector, {q(n)} AS sector_name, {q(p)} AS persona, {qlist(c)} AS critical_codes, "
    f"{qlist(h)} AS high_codes" for k, n, p, c, h in cat.SECTORS)
_GUIDE_SQL = " UNION ALL ".join(
    f"SELECT {q(a)} AS artifact, {q(d)} AS holds" for a, d in cat.ARTIFACTS.items())


@query(sql.query("""
  SELECT r.ord, r.code, r.name, r.description, r.severity, coalesce(n, 0) AS n_packets
  FROM rules r LEFT JOIN (SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(detected) AS code FROM scan)
    GROUP BY 1) USING (code)""", "scan", extra={"rules": _RULES_SQL}))
def rules_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scan.violations(bridge.packets(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return (cat.rules(spark).join(counts, "code", "left")
            .select("ord", "code", "name", "description", "severity", F.coalesce("n", F.lit(0)).alias("n_packets")))


@query(sql.query("""
  SELECT sector, sector_name, persona, CAST(count(*) AS BIGINT) AS n_packets,
    CAST(count(*) FILTER (WHERE list_has_any(detected, critical_codes)) AS BIGINT) AS n_critical,
    CAST(count(*) FILTER (WHERE list_has_any(detected, high_codes)) AS BIGINT) AS n_high
  FROM scan JOIN sectors USING (sector) GROUP BY ALL""", "scan", extra={"sectors": _SECTORS_SQL}))
def sector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan.scan(bridge.packets(spark, sf_dir)).select("sector", "detected")
    flag = lambda codes: F.sum(F.arrays_overlap("detected", codes).cast("bigint"))
    return (scanned.join(F.broadcast(cat.sectors(spark)), "sector")
            .groupBy("sector", "sector_name", "persona")
            .agg(F.count(F.lit(1)).alias("n_packets"), flag("critical_codes").alias("n_critical"),
                 flag("high_codes").alias("n_high")))


@query(sql.query("""
  SELECT sector, code, urgency, sector_severity, CAST(count(*) AS BIGINT) AS n_violations FROM (
    SELECT sector, code, CASE WHEN list_contains(critical_codes, code) THEN 1 WHEN list_contains(high_codes, code) THEN 2
        ELSE 3 END AS urgency,
      CASE WHEN list_contains(critical_codes, code) THEN 'critical' WHEN list_contains(high_codes, code) THEN 'high'
        ELSE """ + SEVERITY_SQL + """ END AS sector_severity
    FROM (SELECT sector, unnest(detected) AS code FROM scan) JOIN sectors USING (sector)) GROUP BY ALL""",
    "scan", extra={"sectors": _SECTORS_SQL}))
def sector_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = audit.sector_worklist(
        scan.violations(bridge.packets(spark, sf_dir)).select("packet_id", "sector", "code"), cat.sectors(spark))
    return (ranked.groupBy("sector", "code", "urgency", "sector_severity")
            .agg(F.count(F.lit(1)).alias("n_violations")))


@query(sql.query("""
  SELECT packet_id, code, name, severity, artifact, look_for, holds
  FROM (SELECT packet_id, unnest(detected) AS code FROM scan) LEFT JOIN rules USING (code) LEFT JOIN guide USING (artifact)""",
    "scan", extra={"rules": _RULES_SQL, "guide": _GUIDE_SQL}))
def artifact_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.violations(bridge.packets(spark, sf_dir)).select("packet_id", "code")
    return (audit.open_for_code(found, cat.rules(spark), cat.artifact_guide(spark))
            .select("packet_id", "code", "name", "severity", "artifact", "look_for", "holds"))


# --- declared against detected -----------------------------------------------

@query(sql.query("""
  SELECT packet_id, code, list_contains(truth, code) AS declared, list_contains(detected, code) AS found,
    CASE WHEN list_contains(truth, code) AND list_contains(detected, code) THEN 'confirmed'
         WHEN list_contains(truth, code) THEN 'undetectable' ELSE 'undeclared' END AS verdict
  FROM (SELECT *, unnest(list_distinct(list_concat(truth, detected))) AS code FROM tscan)""", extra=TEMPLATE_BLOCKS))
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_audit(scan.scan(bridge.template_packets(spark, sf_dir)))


def _kept(keep: str) -> str:
    return f"array_to_string(list_filter({CODES}, lambda c: {keep}), ',')"


_IN_T, _IN_D = "list_contains(truth, c)", "list_contains(detected, c)"


@query(sql.query(f"""
  SELECT packet_id, {_kept(f'{_IN_T} AND {_IN_D}')} AS "both", {_kept(f'{_IN_T} AND NOT {_IN_D}')} AS only_declared,
    {_kept(f'NOT {_IN_T} AND {_IN_D}')} AS only_detected, {_kept(f'NOT {_IN_T}')} AS available,
    array_to_string(list_concat(truth, list_filter(detected, lambda c: NOT {_IN_T})), ',') AS named FROM tscan""",
    extra=TEMPLATE_BLOCKS))
def truth_as_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = audit.set_comparison(scan.scan(bridge.template_packets(spark, sf_dir)))
    return compared.select("packet_id", *[joined(c) for c in (
        "both", "only_declared", "only_detected", "available", "named")])


_SAFE = " AND ".join(
    f"NOT (list_contains(truth, {q(c)}) AND NOT list_contains(detected, {q(c)}))"
    for c, s in cat.SEVERITY.items() if s in cat.SEVERE)
_BASELINE = f"""
  SELECT packet_id, safety, compliance, precision,
    least(1.0, safety * 0.35::DOUBLE + compliance * 0.25::DOUBLE + 0.20::DOUBLE + precision * 0.10::DOUBLE + 0.05::DOUBLE) AS overall
  FROM (SELECT packet_id, CASE WHEN {_SAFE} THEN 1.0 ELSE 0.0 END::DOUBLE AS safety,
      n_both::DOUBLE / greatest(1, len(truth)) AS compliance, n_both::DOUBLE / greatest(1, len(detected)) AS precision
    FROM (SELECT *, len(list_filter(detected, lambda c: list_contains(truth, c))) AS n_both FROM tscan))"""


@query(sql.query("SELECT packet_id, round(safety, 6) AS safety, round(compliance, 6) AS compliance, "
                 "round(precision, 6) AS precision, round(overall, 6) AS overall FROM base",
                 extra={**TEMPLATE_BLOCKS, "base": _BASELINE}))
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grade.rule_scan_baseline(scan.scan(bridge.template_packets(spark, sf_dir)))
    return scored.select("packet_id", *[F.round(c, 6).alias(c) for c in ("safety", "compliance", "precision", "overall")])


@query(sql.query("SELECT CAST(count(*) AS BIGINT) AS n_packets, round(avg(overall), 6) AS average_overall FROM base",
                 extra={**TEMPLATE_BLOCKS, "base": _BASELINE}))
def baseline_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grade.rule_scan_baseline(scan.scan(bridge.template_packets(spark, sf_dir)))
    return scored.agg(F.count(F.lit(1)).alias("n_packets"), F.round(F.avg("overall"), 6).alias("average_overall"))


# --- phrase search over free text --------------------------------------------

DOC_NEGATORS = ["of", "to", "that", "no", "la", "el", "un"]


def _phrase_sql(table: str, key: str, text: str, phrase: str, negators: list[str]) -> str:
    return (f"SELECT {key}, CAST(len(string_split(lower({text}), {q(phrase)})) - 1 AS BIGINT) AS n_found, "
            f"CAST({sql.asserted_count(f'lower({text})', phrase, negators)} AS BIGINT) AS n_asserted FROM {table}")


def _phrase_search(df: DataFrame, keys: list[str], column: str, phrase: str, negators: list[str]) -> DataFrame:
    return df.select(*keys, F.lower(column).alias("low")).selectExpr(
        *keys, f"CAST({occurrences('low', phrase)} AS BIGINT) AS n_found",
        f"CAST({asserted_occurrences('low', phrase, negators)} AS BIGINT) AS n_asserted")


@query(_phrase_sql("documents", "doc_id", "text", "therou", DOC_NEGATORS))
def phrase_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _phrase_search(documents, ["doc_id"], "text", "therou", DOC_NEGATORS)


@query(_phrase_sql("pages", "page_id", "html", "href=", ["<li><a", "and", "the"]))
def phrase_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bridge.table(spark, sf_dir, "pages").select("page_id", "html")
    return _phrase_search(pages, ["page_id"], "html", "href=", ["<li><a", "and", "the"])


@query(_phrase_sql("conversations", "conv_id, turn, role", "text", "the", DOC_NEGATORS))
def phrase_in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bridge.table(spark, sf_dir, "conversations")
    return _phrase_search(turns, ["conv_id", "turn", "role"], "text", "the", DOC_NEGATORS)


# Ten rules per document: one to three of its own words, from ten places; of 12 to 60 characters.
_RULES_OF_TEXTS = """
  SELECT rule_id, phrase FROM (
    SELECT doc_id * 10 + j AS rule_id, array_to_string(w[(doc_id * 13 + j * 17) % len(w) + 1 : (doc_id * 13 + j * 17) % len(w) + 1 + j % 3], ' ') AS phrase
    FROM (SELECT doc_id, string_split(lower(text), ' ') AS w, unnest(range(10)) AS j FROM documents))
  WHERE length(phrase) BETWEEN 12 AND 60 AND len(list_filter(range(1, length(phrase)), lambda i: starts_with(phrase, substr(phrase, i + 1)))) = 0"""


def _rules_of(documents: DataFrame) -> DataFrame:
    own = "struct(doc_id * 10 + j AS rule_id, array_join(slice(w, CAST((doc_id * 13 + j * 17) % size(w) + 1 AS INT), 1 + j % 3), ' ') AS phrase)"
    words = "split(lower(text), ' ', -1)"  # made once for a text's ten rules
    return documents.select(F.expr(f"inline({bind(words, 'w', f'transform(sequence(0, 9), j -> {own})')})")).where("length(phrase) BETWEEN 12 AND 60")


@query(sql.query(f"""
  SELECT rule_id, CAST(count(*) AS BIGINT) AS n_texts, CAST(sum(n_found) AS BIGINT) AS n_found, CAST(sum(n_asserted) AS BIGINT) AS n_asserted FROM (
    SELECT rule_id, len(string_split(low, phrase)) - 1 AS n_found, {sql.asserted_count_of('low', 'phrase', DOC_NEGATORS)} AS n_asserted
    FROM rules JOIN low ON contains(low, phrase))
  GROUP BY rule_id""", extra={"rules": _RULES_OF_TEXTS, "low": "SELECT doc_id, lower(text) AS low FROM documents"}))
def phrase_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = written(_rules_of(documents), "rules-of-texts")
    # a phrase is searched once and its hits are summed before they meet its rules: a phrase of many texts is also the rule of many
    hits = phrase_index.phrase_hits(documents, rules.select(F.col("phrase").alias("rule_id"), "phrase").distinct(), ["doc_id"], negators=DOC_NEGATORS)
    of_phrase = hits.groupBy(F.col("rule_id").alias("phrase")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_found").alias("n_found"), F.sum("n_asserted").alias("n_asserted"))
    return rules.join(of_phrase, "phrase").groupBy("rule_id").agg(*[F.sum(x).alias(x) for x in ("n_texts", "n_found", "n_asserted")])


@query(f"""
  SELECT CAST(count(*) FILTER (WHERE hit AND bad) AS BIGINT) AS true_positive,
    CAST(count(*) FILTER (WHERE hit AND NOT bad) AS BIGINT) AS false_positive,
    CAST(count(*) FILTER (WHERE NOT hit AND bad) AS BIGINT) AS false_negative,
    CAST(count(*) FILTER (WHERE NOT hit AND NOT bad) AS BIGINT) AS true_negative
  FROM (SELECT toxic = 1 AS bad, {sql.asserted_count('lower(text)', 'the', DOC_NEGATORS)} > 0 AS hit
        FROM documents JOIN labels USING (doc_id))""")
def phrase_rule_against_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bridge.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = bridge.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    judged = (documents.join(labels, "doc_id").select("bad", F.lower("text").alias("low"))
              .selectExpr("bad", f"{asserted_occurrences('low', 'the', DOC_NEGATORS)} > 0 AS hit"))
    counts = {"true_positive": F.col("hit") & F.col("bad"), "false_positive": F.col("hit") & ~F.col("bad"),
              "false_negative": ~F.col("hit") & F.col("bad"), "true_negative": ~F.col("hit") & ~F.col("bad")}
    return judged.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])


# --- JSON recovery -----------------------------------------------------------

FENCE3 = "```"
_NOISY_SQL = f"""
  SELECT seq, CASE k % 6 WHEN 0 THEN 'Sure, here it is:' || chr(10) || '{FENCE3}json' || chr(10) || raw || chr(10) || '{FENCE3}' || chr(10) || 'done'
      WHEN 1 THEN '  ' || raw || chr(10) WHEN 2 THEN 'I would say ' || raw || ' because'
      WHEN 3 THEN '{FENCE3}' || raw || '{FENCE3}' WHEN 4 THEN 'a {FENCE3} b {FENCE3} ' || raw
      ELSE 'first ' || raw || ' then ' || raw END AS txt FROM actions_raw"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer answers with their JSON wrapped in six kinds of chatter."""
    raw = F.col("raw")
    text = (F.when(F.col("k") == 0, F.concat(F.lit(f"Sure, here it is:\n{FENCE3}json\n"), raw, F.lit(f"\n{FENCE3}\ndone")))
            .when(F.col("k") == 1, F.concat(F.lit("  "), raw, F.lit("\n")))
            .when(F.col("k") == 2, F.concat(F.lit("I would say "), raw, F.lit(" because")))
            .when(F.col("k") == 3, F.concat(F.lit(FENCE3), raw, F.lit(FENCE3)))
            .when(F.col("k") == 4, F.concat(F.lit(f"a {FENCE3} b {FENCE3} "), raw))
            .otherwise(F.concat(F.lit("first "), raw, F.lit(" then "), raw)))
    return bridge.raw_actions(spark, sf_dir).select("seq", "raw", (F.col("k") % 6).alias("k")).select("seq", text.alias("txt"))


_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_CLEAN = (f"list_transform(list_transform(string_split(whole, '{FENCE3}'), lambda p: {_TRIM.format('p')}), "
          f"lambda p: CASE WHEN starts_with(p, 'json') THEN {_TRIM.format('substr(p, 5)')} ELSE p END)")


@query(sql.query(f"""
  SELECT seq, CASE WHEN contains(whole, '{FENCE3}') AND len(good) > 0 THEN good[1] WHEN json_valid(whole) THEN whole
    WHEN json_valid(flat) THEN flat ELSE '{{}}' END AS json
  FROM (SELECT *, list_filter({_CLEAN}, lambda p: json_valid(p)) AS good,
      regexp_extract(whole, '\\{{[^{{}}]*\\}}') AS flat
    FROM (SELECT seq, {_TRIM.format('txt')} AS whole FROM noisy))""", "actions_raw", extra={"noisy": _NOISY_SQL}))
def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("seq", act.recovered_json("txt").alias("json"))


@query(sql.query(f"""
  SELECT seq, CASE WHEN json_valid(body) THEN body END AS json FROM (
    SELECT seq, {_TRIM.format(f"CASE WHEN starts_with(whole, '{FENCE3}') THEN clean[2] ELSE whole END")} AS body
    FROM (SELECT *, list_transform(string_split(whole, '{FENCE3}'),
        lambda p: CASE WHEN starts_with(p, 'json') THEN substr(p, 5) ELSE p END) AS clean
      FROM (SELECT seq, {_TRIM.format('txt')} AS whole FROM noisy)))""", "actions_raw", extra={"noisy": _NOISY_SQL}))
def unfenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("seq", act.unfenced_json("txt").alias("json"))


@query(sql.query("""
  SELECT seq, action, json_valid(action) AS is_json FROM (
    SELECT seq, CASE WHEN regexp_extract(txt, '(?s)\\{.*\\}') <> '' THEN regexp_extract(txt, '(?s)\\{.*\\}') ELSE txt END
      AS action FROM noisy)""", "actions_raw", extra={"noisy": _NOISY_SQL}))
def embedded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _noisy(spark, sf_dir).select("seq", act.embedded_action("txt").alias("action"))
    return found.withColumn("is_json", F.expr(act.is_json("action")))
