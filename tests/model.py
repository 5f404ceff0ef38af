"""A plain sequential model of a review, for comparison only."""

import json

from govaudit import catalog as cat

R = cat.REWARD
FIELDS = {"action_type", "target", "severity", "issue_code", "note"}


def parse(raw):
    """The action as a dict, or None when malformed."""
    try:
        doc = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(doc, dict) or doc.get("action_type") not in cat.ACTION_TYPES:
        return None
    for name in FIELDS:
        value = doc.get(name)
        if value is not None and not isinstance(value, str):
            return None
        if value is not None and len(value) > cat.MAX_LENGTH.get(name, 10**6):
            return None
    if doc.get("severity") not in (None, *cat.SEVERITIES):
        return None
    return doc


def play(raws, packet, max_steps):
    """[(status, step, reward)] per raw action, and the final state."""
    s = {"step": 0, "done": False, "inspected": [], "flagged": [], "false": [], "mitigated": [], "risk": None,
         "total": 0.0, "decision": None}
    out = []
    for raw in raws:
        if s["done"]:
            out.append(("post_terminal_action", None, 0.0))
            continue
        s["step"] += 1
        a = parse(raw)
        if a is None:
            out.append(("invalid", s["step"], R["invalid"]))
            continue
        reward = _earn(s, a, packet)
        if not s["done"]:
            reward += R["tax"]
        if s["step"] >= max_steps and not s["done"]:
            s["done"] = True
            reward += R["timeout"]
        s["total"] += reward
        out.append(("scored", s["step"], reward))
    return out, s


def _earn(s, a, p):
    kind, code = a["action_type"], a.get("issue_code") or ""
    if kind == cat.INSPECT:
        target = a.get("target") or ""
        if target not in cat.ARTIFACTS:
            return R["inspect_unknown"]
        if target in s["inspected"]:
            return 0.0
        s["inspected"].append(target)
        bonus = R["inspect_first"] if len(s["inspected"]) == 1 else 0.0
        return R["inspect"] + bonus + (R["inspect_last"] if len(s["inspected"]) == len(cat.ARTIFACTS) else 0.0)
    if kind == cat.FLAG:
        if not code:
            return R["flag_empty"]
        if code in s["flagged"]:
            return 0.0
        if code in p["truth"]:
            s["flagged"].append(code)
            return R["flag_severity"] if a.get("severity") == cat.SEVERITY.get(code, "medium") else R["flag"]
        s["false"].append(code)
        return R["flag_wrong"]
    if kind == cat.MITIGATE:
        key = code or a.get("target") or ""
        if key not in s["flagged"]:
            return R["mitigate_early"]
        if key in s["mitigated"]:
            return 0.0
        s["mitigated"].append(key)
        return R["mitigate"]
    if kind == cat.SET_RISK:
        if not a.get("severity"):
            return R["risk_missing"]
        s["risk"] = a["severity"]
        return R["risk"] if s["risk"] == p["expected_risk"] else R["risk_wrong"]
    if kind == cat.FINALIZE:
        return R["finalize"]
    s["done"], s["decision"] = True, kind
    if kind == p["expected_decision"]:
        reward = R["decide"]
    else:
        reward = R["decide_unsafe"] if (p["expected_decision"], kind) == ("reject", "approve") else R["decide_wrong"]
    reward += R["final_risk"] if s["risk"] == p["expected_risk"] else R["final_risk_wrong"]
    for c in p["truth"]:
        if c not in s["flagged"]:
            reward += R["missed_severe"] if cat.SEVERITY.get(c, "medium") in cat.SEVERE else R["missed"]
    return reward + R["final_fp"] * len(s["false"]) + R["final_mitigated"] * len(s["mitigated"])


def rate(wins, rating=1000.0):
    """Rating after each round."""
    out = []
    for won in wins:
        target = rating + 100
        opponent = 950 if target < 1100 else 1250 if target < 1400 else 1550
        rating = max(400.0, rating + 32 * ((1.0 if won else 0.0) - 1 / (1 + 10 ** ((opponent - rating) / 400))))
        out.append(rating)
    return out


def miss_rate(outcomes, rate=5000):
    for missed in outcomes:
        rate = (30000 * missed + 7 * rate + 5) // 10
    return rate


def asserted(text, phrase, negators):
    """Occurrences without a negator in the six words (50 characters) before."""
    n, at = 0, text.find(phrase)
    while at != -1:
        words = [w.strip(".,;:\"'()") for w in text[max(0, at - 50):at].split()[-6:]]
        n += not set(words) & set(negators)
        at = text.find(phrase, at + 1)
    return n
