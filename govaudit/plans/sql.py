"""Building blocks for the SQL twins of the registered queries.

Every block is a common table expression over the driver's views, written
independently of the DataFrame code (plain windows over whole tables, no
limits, no salting), so that the two can be compared.
"""

from __future__ import annotations

from govaudit import catalog as cat
from govaudit.functions.packet_text import APPENDED, PATCHES, PIECES, TEMPLATE
from govaudit.sources import bridge


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case_map(expr: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items())
    return f"CASE {expr} {whens} ELSE {otherwise} END"


def severity(expr: str, default: str = "medium") -> str:
    return case_map(expr, cat.SEVERITY, q(default))


def band(expr: str, bands: list[tuple[float, str]], otherwise: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {low}::DOUBLE THEN {q(label)}" for low, label in bands)
    return f"CASE {whens} ELSE {q(otherwise)} END"


def listed(values: str) -> str:
    return f"array_to_string({values}, ',')"


def col_of(artifact: str) -> str:
    return artifact.replace(".", "_")


CODES = qlist(cat.CODES)
NONE = "CAST([] AS VARCHAR[])"


def codes_of_mask(mask: str) -> str:
    bits = ", ".join(f"CASE WHEN ({mask} >> {i}) & 1 = 1 THEN {q(c)} END" for i, c in enumerate(cat.CODES))
    return f"list_filter([{bits}], lambda c: c IS NOT NULL)"


def filled(text: str, values: dict[str, str]) -> str:
    out = q(text)
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return "(" + out + ")"


def planted_text(artifact: str, truth: str, domain: str, days: str) -> str:
    values = {"domain": domain, "days": days}
    parts = [filled(on, values) if code is None else
             f"CASE WHEN list_contains({truth}, {q(code)}) THEN {filled(on, values)} ELSE {filled(off, values)} END"
             for code, on, off in PIECES[artifact]]
    return " || ".join(parts)


def patched_text(artifact: str, old: str, planted: str) -> str:
    for code, (name, text) in PATCHES.items():
        if name == artifact:
            new = f"{old} || {q(text)}" if code == APPENDED else q(text)
            return f"CASE WHEN list_contains({planted}, {q(code)}) THEN {new} ELSE {old} END"
    return old


def template_text(artifact: str, domain: str, title: str) -> str:
    return filled(TEMPLATE[artifact], {"domain": domain, "title": title})


def has_severity(truth: str, level: str) -> str:
    codes = qlist([c for c, s in cat.SEVERITY.items() if s == level])
    return f"list_has_any({truth}, {codes})"


def risk_of(truth: str, needed: int) -> str:
    return (f"CASE WHEN {has_severity(truth, 'critical')} AND len({truth}) >= {needed} THEN 'critical' "
            f"WHEN {has_severity(truth, 'critical')} OR {has_severity(truth, 'high')} THEN 'high' ELSE 'medium' END")


def decision_of(truth: str) -> str:
    return f"CASE WHEN {has_severity(truth, 'critical')} THEN 'reject' ELSE 'escalate' END"


# --- phrase search -----------------------------------------------------------

def asserted_count(text: str, phrase: str, negators: list[str] = cat.NEGATORS) -> str:
    """Occurrences without a negator among the six words (50 characters) before."""
    return _asserted(text, q(phrase), f"array_to_string(list_slice(string_split({text}, {q(phrase)}), 1, i), {q(phrase)})", negators)


def asserted_count_of(text: str, phrase: str, negators: list[str]) -> str:
    """The same for a phrase that is an expression."""
    pieces = f"list_slice(string_split({text}, {phrase}), 1, i)"
    return _asserted(text, phrase, f"array_to_string(list_transform({pieces}[:-2], lambda p: p || {phrase}), '') || {pieces}[-1]", negators)


def _asserted(text: str, phrase: str, before: str, negators: list[str]) -> str:
    words = f"list_filter(regexp_split_to_array(right({before}, 50), '\\s+'), lambda w: w <> '')"
    bare = f"list_transform({words}[-6:], lambda w: trim(w, {q('.,;:' + chr(34) + chr(39) + '()')}))"
    return (f"len(list_filter(range(1, len(string_split({text}, {phrase}))), "
            f"lambda i: NOT list_has_any({bare}, {qlist(negators)})))")


# --- rules -------------------------------------------------------------------

def rule_messages(prefix: str = "") -> dict[str, str]:
    """Violation message (NULL = pass) per code, over artifact columns."""
    raw = {a: f"coalesce({prefix}{col_of(a)}, '')" for a in cat.ARTIFACTS}
    low = {a: f"lower({raw[a]})" for a in cat.ARTIFACTS}
    say = cat.RULE_MESSAGES

    def has(artifact: str, *needles: str) -> str:
        return "(" + " OR ".join(f"contains({low[artifact]}, {q(n)})" for n in needles) + ")"

    log, spec, card = "logging_policy.yaml", "product_spec.md", "model_card.json"
    before, after = say["PII-001"].split("%s")
    section = f"substr({low['human_oversight.md']}, strpos({low['human_oversight.md']}, 'escalation'), 300)"
    plans = " ".join(
        f"WHEN regexp_matches({section}, {q(p)}) THEN {q(say['ESCALATION-003'].replace('%s', p))}"
        for p in cat.INCOMPLETE_PLAN)
    domains = " ".join(
        f"WHEN contains({low[spec]}, {q(p)}) AND {asserted_count(low[spec], p)} > 0 "
        f"THEN {q(say['DOMAIN-004'].replace('%s', shown))}" for p, shown in cat.PROHIBITED)
    digits = f"regexp_extract({raw['retention_policy.yaml']}, {q(cat.RETENTION_DAYS)}, 1)"
    days = f"TRY_CAST({digits} AS HUGEINT)"
    r_before, r_after = say["RETENTION-005"].split("%s")
    return {
        "PII-001": f"CASE WHEN {has(log, 'raw_prompt_capture: enabled', 'capture: full')} AND "
                   f"(regexp_matches({low[log]}, {q(cat.PII_FILTER_OFF)}) OR NOT {has(log, 'pii_filter')}) THEN "
                   f"{q(before)} || left(regexp_extract({raw[log]}, {q(cat.PII_SNIPPET)}), 80) || {q(after)} END",
        "ACCESS-002": "CASE WHEN " + has("data_sources.json", '"sensitive": true', '"sensitive":true')
                      + f" AND NOT {has('data_sources.json', 'least_privilege')} THEN {q(say['ACCESS-002'])} END",
        "ESCALATION-003": f"CASE WHEN NOT {has(card, 'high', 'critical')} THEN NULL "
                          f"WHEN strpos({low['human_oversight.md']}, 'escalation') = 0 THEN "
                          f"{q(say['ESCALATION-003/absent'])} {plans} END",
        "DOMAIN-004": f"CASE {domains} END",
        "RETENTION-005": f"CASE WHEN {digits} <> '' AND {days} > 90 THEN {q(r_before)} || {days} || {q(r_after)} END",
        "TRAINING-006": "CASE WHEN " + has(card, '"provider": "external"', '"provider":"external"')
                        + f" AND {has(card, 'training on prompts')} AND NOT {has(card, 'disabled', 'opted_out')} "
                        f"THEN {q(say['TRAINING-006'])} END",
        "AUDIT-007": f"CASE WHEN ({has(spec, 'admin', 'write access')} OR ({has(spec, 'action')} AND NOT "
                     f"{has(spec, 'read-only')})) AND NOT ({has('security_review.md', 'audit')} AND "
                     f"{has('security_review.md', 'trail')} AND {has('security_review.md', 'rollback')}) "
                     f"THEN {q(say['AUDIT-007'])} END",
        "EVAL-008": f"CASE WHEN {raw['eval_report.json']} = '' THEN {q(say['EVAL-008/absent'])} "
                    f"WHEN NOT {has('eval_report.json', *cat.EVAL_TERMS)} THEN {q(say['EVAL-008'])} END",
    }


def scanned(source: str) -> str:
    """``source`` plus one message column per rule and the list ``detected``."""
    messages = rule_messages()
    columns = ", ".join(f"{m} AS m{i}" for i, m in enumerate(messages.values()))
    found = ", ".join(f"CASE WHEN m{i} IS NOT NULL THEN {q(c)} END" for i, c in enumerate(messages))
    return (f"SELECT *, list_filter([{found}], lambda c: c IS NOT NULL) AS detected "
            f"FROM (SELECT *, {columns} FROM {source})")


def checks(source: str) -> str:
    """One row per packet and rule of a scanned source."""
    return " UNION ALL ".join(
        f"SELECT packet_id, {i} AS ord, {q(c)} AS code, m{i} IS NULL AS passed, coalesce(m{i}, '') AS message "
        f"FROM {source}" for i, c in enumerate(cat.CODES))


# --- common table expressions ------------------------------------------------

def _packets() -> str:
    texts = ", ".join(f"{planted_text(a, 'truth', 'domain', 'days')} AS {col_of(a)}" for a in cat.ARTIFACTS)
    domain = f"({qlist([d[1] for d in cat.DOMAINS])})[(c_nationkey % 10) + 1]"
    return f"""
      SELECT c_custkey AS packet_id, 'Assistant ' || c_custkey AS feature_name,
             'Desk assistant for ' || lower(domain) AS feature_summary, truth, domain,
             CASE WHEN len(truth) = 0 THEN 'low' ELSE {risk_of('truth', 2)} END AS expected_risk,
             CASE WHEN len(truth) = 0 THEN 'approve' ELSE {decision_of('truth')} END AS expected_decision,
             {case_map('c_mktsegment', bridge.SECTOR_OF, 'NULL')} AS sector, {texts}
      FROM (SELECT *, CASE WHEN list_contains(truth, 'RETENTION-005') THEN 91 + 10 * c_nationkey
                           ELSE 30 + 2 * c_nationkey END AS days
            FROM (SELECT *, {codes_of_mask('c_custkey')} AS truth, {domain} AS domain FROM customer))"""


EPISODE_BUCKET = "(date_diff('day', DATE '2024-01-01', ts::DATE) // 10)"


def _actions_raw() -> str:
    def pick(values: list[str], index: str) -> str:
        return f"({qlist(values)})[({index}) + 1]"

    def field(name: str, value: str) -> str:
        return f"""', "{name}": "' || {value} || '"'"""

    def act(kind: str, *rest: str) -> str:
        return " || ".join([q('{"action_type": "' + kind + '"'), *rest, "'}'"])

    tens = "k // 10"
    sev = f"CASE WHEN {tens} % 5 = 4 THEN '' ELSE {field('severity', pick([*cat.SEVERITIES, ''], tens + ' % 5'))} END"
    code = pick(bridge.FLAG_CODES, "k % 10")
    own = field("severity", case_map(code, {**cat.SEVERITY, "": "low", "GHOST-999": "high"}, "NULL"))
    inspect = act(cat.INSPECT, field("target", pick(bridge.TARGETS, "k % 10")))
    mitigate = pick(cat.CODES, "k % 8")
    note = field("note", "'seen ' || k")
    return f"""
      SELECT user_id || '-' || {EPISODE_BUCKET} AS episode_id, event_id AS seq, ts, user_id AS agent, k, event_type,
        CASE
          WHEN event_type = 'view' THEN {inspect}
          WHEN event_type = 'click' THEN {act(cat.FLAG, field('issue_code', code),
               f"(CASE WHEN {tens} % 2 = 0 THEN {own} ELSE {sev} END)", note)}
          WHEN event_type = 'signup' AND k < 80 THEN {act(cat.MITIGATE, field('issue_code', mitigate))}
          WHEN event_type = 'signup' THEN {act(cat.MITIGATE, field('issue_code', "''"), field('target', mitigate))}
          WHEN event_type = 'purchase' THEN {act(cat.SET_RISK, f'({sev})')}
          WHEN k % 10 = 0 THEN '{{"action_type": "' || {pick(bridge.DECIDE, tens + ' % 4')} || '"}}'
          WHEN k % 10 = 1 THEN {pick(bridge.MALFORMED, tens)}
          ELSE {inspect} END AS raw
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def _actions() -> str:
    def text_ok(name: str) -> str:
        return f"coalesce(json_type(doc, '$.{name}'), 'NULL') IN ('VARCHAR', 'NULL')"

    def value(name: str) -> str:
        return f"json_extract_string(doc, '$.{name}')"

    lengths = " AND ".join(f"coalesce(length({value(n)}) <= {m}, true)" for n, m in cat.MAX_LENGTH.items())
    valid = f"""json_type(doc) = 'OBJECT' AND coalesce(json_type(doc, '$.action_type') = 'VARCHAR', false)
        AND coalesce({value('action_type')} IN ({', '.join(map(q, cat.ACTION_TYPES))}), false)
        AND {' AND '.join(text_ok(n) for n in ('target', 'severity', 'issue_code', 'note'))}
        AND coalesce({value('severity')} IN ({', '.join(map(q, cat.SEVERITIES))}), {value('severity')} IS NULL)
        AND {lengths}"""
    fields = ", ".join(f"CASE WHEN valid THEN {value(n)} END AS {n}"
                       for n in ("action_type", "target", "severity", "issue_code", "note"))
    # A malformed text is judged as '{}', which no rule accepts.
    return (f"SELECT * EXCLUDE (doc), {fields} FROM (SELECT *, {valid} AS valid FROM "
            "(SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS doc FROM actions_raw))")


def replayed(max_steps: int = cat.MAX_STEPS, actions: str = "actions", assigned: str = "assigned") -> str:
    """Every counted action with its reward, reason and running state."""
    r, say = cat.REWARD, cat.STEP_MESSAGES
    decides = "action_type IN ('approve', 'reject', 'escalate')"
    severe = qlist([c for c, s in cat.SEVERITY.items() if s in cat.SEVERE])
    missed = "list_filter(truth, lambda c: NOT list_contains(flagged, c))"

    def fmt(name: str, *values: str) -> str:
        return "printf(" + ", ".join([q(say[name]), *values]) + ")" if values else q(say[name])

    def lines(values: str, body: str) -> str:
        return f"list_transform({values}, lambda c: {body})"

    penalty = f"CASE WHEN list_contains({severe}, c) THEN '1.5' ELSE '0.5' END"
    verdict = (f"CASE WHEN action_type = expected_decision THEN {fmt('decide', 'action_type')} "
               f"WHEN action_type = 'approve' AND expected_decision = 'reject' THEN {fmt('decide_unsafe')} "
               f"ELSE {fmt('decide_wrong', 'action_type', 'expected_decision')} END")
    risk_line = (f"CASE WHEN risk = expected_risk THEN {fmt('final_risk', 'risk')} "
                 f"ELSE {fmt('final_risk_wrong', chr(99) + 'oalesce(risk, ' + q('None') + ')', 'expected_risk')} END")
    summary = (f"array_to_string(list_concat([{verdict}, {risk_line}], "
               f"{lines(missed, fmt('missed', 'c', severity('c'), penalty))}, "
               f"{lines('false_codes', fmt('final_fp', 'c'))}, "
               f"{lines('list_filter(flagged, lambda f: list_contains(mitigated, f))', fmt('final_mitigated', 'c'))}), "
               "chr(10))")
    return f"""
      SELECT *,
        CASE WHEN timed_out THEN {fmt('timeout')}
          WHEN {decides} THEN printf({q(say['decided'])}, {summary}, total_so_far)
          WHEN action_type = 'inspect_artifact' AND NOT is_artifact
            THEN {fmt('inspect_unknown', 'key', "array_to_string(artifact_names, ', ')")}
          WHEN action_type = 'inspect_artifact' AND NOT new_inspect THEN {fmt('inspect_again', 'key')}
          WHEN action_type = 'inspect_artifact' THEN {fmt('inspect', 'key', 'len(inspected)', 'len(artifact_names)')}
          WHEN action_type = 'flag_issue' AND key = '' THEN {fmt('flag_empty')}
          WHEN wrong_flag THEN {fmt('flag_wrong', 'key')}
          WHEN action_type = 'flag_issue' AND NOT new_flag THEN {fmt('flag_again', 'key')}
          WHEN action_type = 'flag_issue' AND right_severity THEN {fmt('flag_severity', 'key')}
          WHEN action_type = 'flag_issue' THEN {fmt('flag', 'key')}
          WHEN action_type = 'request_mitigation' AND NOT flagged_before THEN {fmt('mitigate_early', 'key')}
          WHEN action_type = 'request_mitigation' AND NOT new_mitigation THEN {fmt('mitigate_again', 'key')}
          WHEN action_type = 'request_mitigation' THEN {fmt('mitigate', 'key')}
          WHEN action_type = 'set_risk' AND severity IS NULL THEN {fmt('risk_missing')}
          WHEN action_type = 'set_risk' AND severity = expected_risk THEN {fmt('risk', 'severity')}
          WHEN action_type = 'set_risk' THEN {fmt('risk_wrong', 'severity', 'expected_risk')}
          ELSE {fmt('finalize')} END AS reason
      FROM (SELECT *, sum(reward) OVER so_far AS total_so_far FROM (
        SELECT *, p_inspection + p_flagging + p_false_positive + p_mitigation + p_risk + p_decision + p_missed + p_tax
          AS reward FROM (
        SELECT *,
          (CASE WHEN action_type <> 'inspect_artifact' THEN 0 WHEN NOT is_artifact THEN {r['inspect_unknown']}
             WHEN NOT new_inspect THEN 0
             ELSE {r['inspect']} + CASE WHEN len(inspected) = 1 THEN {r['inspect_first']} ELSE 0 END
                  + CASE WHEN len(inspected) = len(artifact_names) THEN {r['inspect_last']} ELSE 0 END END)::DOUBLE
            AS p_inspection,
          (CASE WHEN action_type = 'flag_issue' AND key = '' THEN {r['flag_empty']}
             WHEN new_flag AND right_severity THEN {r['flag_severity']} WHEN new_flag THEN {r['flag']}
             ELSE 0 END)::DOUBLE AS p_flagging,
          (CASE WHEN wrong_flag THEN {r['flag_wrong']} WHEN {decides} THEN len(false_codes) * {r['final_fp']}
             ELSE 0 END)::DOUBLE AS p_false_positive,
          (CASE WHEN action_type = 'request_mitigation' AND NOT flagged_before THEN {r['mitigate_early']}
             WHEN new_mitigation THEN {r['mitigate']} WHEN {decides} THEN len(mitigated) * {r['final_mitigated']}
             ELSE 0 END)::DOUBLE AS p_mitigation,
          (CASE WHEN action_type = 'set_risk' AND severity IS NULL THEN {r['risk_missing']}
             WHEN action_type = 'set_risk' AND severity = expected_risk THEN {r['risk']}
             WHEN action_type = 'set_risk' THEN {r['risk_wrong']}
             WHEN {decides} AND risk IS NOT DISTINCT FROM expected_risk THEN {r['final_risk']}
             WHEN {decides} THEN {r['final_risk_wrong']} ELSE 0 END)::DOUBLE AS p_risk,
          (CASE WHEN action_type = 'finalize_review' THEN {r['finalize']} WHEN NOT {decides} THEN 0
             WHEN action_type = expected_decision THEN {r['decide']}
             WHEN action_type = 'approve' AND expected_decision = 'reject' THEN {r['decide_unsafe']}
             ELSE {r['decide_wrong']} END)::DOUBLE AS p_decision,
          (CASE WHEN {decides} THEN
             len(list_filter({missed}, lambda c: list_contains({severe}, c))) * {r['missed_severe']}
             + len(list_filter({missed}, lambda c: NOT list_contains({severe}, c))) * {r['missed']}
             ELSE 0 END)::DOUBLE AS p_missed,
          (CASE WHEN {decides} THEN 0 ELSE {r['tax']} END
             + CASE WHEN timed_out THEN {r['timeout']} ELSE 0 END)::DOUBLE AS p_tax
        FROM (
        SELECT *, terminal AND NOT {decides} AS timed_out,
          coalesce(list(key) FILTER (WHERE new_inspect) OVER so_far, {NONE}) AS inspected,
          coalesce(list(key) FILTER (WHERE new_flag) OVER so_far, {NONE}) AS flagged,
          coalesce(list(key) FILTER (WHERE wrong_flag) OVER so_far, {NONE}) AS false_codes,
          coalesce(list(key) FILTER (WHERE new_mitigation) OVER so_far, {NONE}) AS mitigated,
          last_value(CASE WHEN action_type = 'set_risk' THEN severity END IGNORE NULLS) OVER so_far AS risk
        FROM (
        SELECT *, is_mitigation AND NOT coalesce(max(is_mitigation) OVER key_before, false) AS new_mitigation
        FROM (
        SELECT *, is_artifact AND NOT coalesce(max(is_artifact) OVER key_before, false) AS new_inspect,
          is_true AND NOT flagged_before AS new_flag,
          action_type = 'flag_issue' AND key <> '' AND NOT is_true AS wrong_flag,
          coalesce(severity = {severity('key')}, false) AS right_severity,
          action_type = 'request_mitigation' AND flagged_before AS is_mitigation
        FROM (
        SELECT *, coalesce(max(is_true) OVER key_before, false) AS flagged_before FROM (
        SELECT *, action_type = 'inspect_artifact' AND list_contains(artifact_names, key) AS is_artifact,
          action_type = 'flag_issue' AND list_contains(truth, key) AS is_true
        FROM (
        SELECT a.* EXCLUDE (agent), g.* EXCLUDE (episode_id),
          CASE WHEN action_type = 'inspect_artifact' THEN coalesce(target, '')
               WHEN action_type = 'flag_issue' THEN coalesce(issue_code, '')
               WHEN action_type = 'request_mitigation' THEN coalesce(nullif(issue_code, ''), target, '')
               ELSE '' END AS key
        FROM (SELECT *, coalesce(max(terminal) OVER (PARTITION BY episode_id ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
              FROM (SELECT *, valid AND ({decides} OR step >= {max_steps}) AS terminal
                    FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) AS step
                          FROM {actions}))) a
        JOIN {assigned} g USING (episode_id)
        WHERE valid AND NOT ended))
        WINDOW key_before AS (PARTITION BY episode_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WINDOW key_before AS (PARTITION BY episode_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WINDOW key_before AS (PARTITION BY episode_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        WINDOW so_far AS (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))
        WINDOW so_far AS (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def state_of(steps: str, assigned: str = "assigned") -> str:
    none = NONE
    return f"""
      SELECT g.*, coalesce(l.inspected, {none}) AS inspected, coalesce(l.flagged, {none}) AS flagged,
        coalesce(l.false_codes, {none}) AS false_codes, coalesce(l.mitigated, {none}) AS mitigated, l.risk,
        CASE WHEN l.action_type IN ('approve', 'reject', 'escalate') THEN l.action_type END AS decision,
        coalesce(l.terminal, false) AS done, coalesce(l.timed_out, false) AS timed_out,
        coalesce(t.total_reward, 0.0) AS total_reward, coalesce(t.n_valid, 0) AS n_valid,
        CASE WHEN len(coalesce(l.flagged, {none})) > 0 AND l.risk IS NOT NULL THEN 'decision'
             WHEN len(coalesce(l.inspected, {none})) >= len(g.artifact_names) * 0.5 THEN 'evaluation'
             ELSE 'inspection' END AS review_stage
      FROM {assigned} g
      LEFT JOIN (SELECT * FROM {steps} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC) = 1) l
        USING (episode_id)
      LEFT JOIN (SELECT episode_id, sum(reward) AS total_reward, count(*) AS n_valid FROM {steps} GROUP BY 1) t
        USING (episode_id)"""


def lengths_of(steps: str, actions: str = "actions") -> str:
    return f"""
      SELECT a.episode_id,
        CAST(count(*) FILTER (WHERE end_seq IS NULL OR seq <= end_seq) AS BIGINT) AS step_count,
        CAST(count(*) FILTER (WHERE NOT valid AND (end_seq IS NULL OR seq <= end_seq)) AS BIGINT) AS n_invalid,
        CAST(count(*) FILTER (WHERE seq > end_seq) AS BIGINT) AS n_post_terminal
      FROM {actions} a LEFT JOIN (SELECT episode_id, seq AS end_seq FROM {steps} WHERE terminal) e USING (episode_id)
      GROUP BY 1"""


def graded(state: str) -> str:
    severe = qlist([c for c, s in cat.SEVERITY.items() if s in cat.SEVERE])

    def clamp(x: str) -> str:
        return f"greatest({cat.SCORE_MIN}::DOUBLE, least({cat.SCORE_MAX}::DOUBLE, ({x})::DOUBLE))"

    caught = "list_filter(truth, lambda c: list_contains(flagged, c))"
    weights = " + ".join(f"{n} * {w}::DOUBLE" for n, w in cat.SCORE_WEIGHTS.items())
    return f"""
      SELECT *, {clamp(weights)} AS overall FROM (
        SELECT *,
          len(list_filter(truth, lambda c: list_contains({severe}, c) AND NOT list_contains(flagged, c))) = 0 AS is_safe,
          {clamp(f"CASE WHEN len(list_filter(truth, lambda c: list_contains({severe}, c) AND NOT list_contains(flagged, c))) = 0 THEN 1.0 ELSE 0.0 END")} AS safety,
          {clamp(f"len({caught})::DOUBLE / greatest(1, len(truth))")} AS compliance,
          {clamp("len(inspected)::DOUBLE / greatest(1, len(artifact_names))")} AS completeness,
          {clamp("len(flagged)::DOUBLE / greatest(1, len(flagged) + len(false_codes))")} AS precision,
          {clamp(f"len(list_filter({caught}, lambda c: list_contains(mitigated, c)))::DOUBLE / greatest(1, len({caught}))")} AS mitigation_quality,
          {caught} AS caught, list_filter(truth, lambda c: NOT list_contains(flagged, c)) AS missed
        FROM {state})"""


CTES: dict[str, tuple[list[str], str]] = {
    "packets": ([], _packets()),
    "scan": (["packets"], scanned("packets")),
    "actions_raw": ([], _actions_raw()),
    "actions": (["actions_raw"], _actions()),
    "reviews": ([], f"""
      SELECT DISTINCT user_id || '-' || {EPISODE_BUCKET} AS episode_id, user_id AS agent,
        {EPISODE_BUCKET} AS bucket, (user_id * {bridge.AGENT_STRIDE} + {EPISODE_BUCKET} * {bridge.BUCKET_STRIDE}) % (SELECT count(*) FROM customer) AS packet_id
      FROM events"""),
    "assigned": (["reviews", "packets"], f"""
      SELECT episode_id, agent, bucket, packet_id, truth, expected_risk, expected_decision,
        {qlist(list(cat.ARTIFACTS))} AS artifact_names
      FROM reviews JOIN packets USING (packet_id)"""),
    "steps": (["actions", "assigned"], replayed()),
    "state": (["steps", "assigned"], state_of("steps")),
    "lengths": (["steps", "actions"], lengths_of("steps")),
    "grades": (["state"], graded("state")),
}


def query(select: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the needed blocks (and local ones) in front of ``select``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][0]:
                add(dependency)
            order.append(name)

    for name in needs:
        add(name)
    blocks = {name: CTES[name][1] for name in order} | (extra or {})
    head = ",\n".join(f"{name} AS ({body})" for name, body in blocks.items())
    return (f"WITH {head}\n" if head else "") + select
