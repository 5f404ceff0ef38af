"""Reviewer actions as JSON: strict validation, and recovery from noisy text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.sqltext import bind, text, texts

FLAT_OBJECT = r"\{[^{}]*\}"
OUTER_OBJECT = r"(?s)\{.*\}"
BLANKS = " \t\n\r\x0b\x0c"
FENCE = "```"


def _alone(value: str) -> str:
    """Does nothing but blanks follow the first JSON value of the text?

    The parser stops after the first value and ignores the rest.  If the first
    closing brace is also the end of the text, nothing can follow.  Otherwise
    the text is parsed again within brackets, where more text has to fit an
    array, and within braces, where it has to fit an object: no text fits both.
    """
    within = f"array(concat('[', {value}, ']'), concat('{{\"v\":', {value}, '}}'))"
    return (f"CASE WHEN instr({value}, '}}') > 0 AND btrim(substring({value}, instr({value}, '}}') + 1), {text(BLANKS)}) = '' "
            f"THEN true ELSE coalesce(forall({within}, w -> try_parse_json(w) IS NOT NULL), false) END")


FIELDS = ["action_type", "target", "severity", "issue_code", "note"]


def parse_actions(log: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the five action fields and ``valid``; fields are NULL when invalid.

    Valid means: the whole text is one JSON object; ``action_type`` is one of
    the known types; ``severity`` is absent, null or a known level; the texts
    are strings within their length limits.  Other keys are ignored.
    """
    # One look at the schema settles the types of a flat object; objects with
    # nested values are asked field by field.  The rare branches are array functions,
    # which keeps the generated code of the common one small enough to compile.
    by_field = bind("try_variant_get(_doc, '$', 'MAP<STRING, VARIANT>')", "m", (
        f"forall({texts(FIELDS)}, n -> coalesce(schema_of_variant(try_element_at(m, n)), 'VOID') IN ('STRING', 'VOID'))"))
    wrong_type = "[< ](" + "|".join(FIELDS) + r"): (?!(STRING|VOID)[,>])"
    texts_only = (f"CASE WHEN NOT startswith(coalesce(_schema, ''), 'OBJECT') THEN false "
                  f"WHEN instr(substring(_schema, 8), '<') = 0 THEN NOT _schema RLIKE {text(wrong_type)} ELSE {by_field} END")
    checks = [f"coalesce({texts_only}, false)",
              f"coalesce(array_contains({texts(cat.ACTION_TYPES)}, _act.action_type), false)",
              f"coalesce(array_contains({texts(cat.SEVERITIES)}, _act.severity), true)",
              *[f"coalesce(char_length(_act.{n}) <= {m}, true)" for n, m in cat.MAX_LENGTH.items()],
              _alone(raw)]
    struct = ", ".join(f"{n}: STRING" for n in FIELDS)
    return (log.selectExpr("*", f"try_parse_json({raw}) AS _doc")
            .selectExpr("*", f"try_variant_get(_doc, '$', 'STRUCT<{struct}>') AS _act", "schema_of_variant(_doc) AS _schema")
            .selectExpr(*log.columns, "_act", " AND ".join(checks) + " AS valid")
            .selectExpr(*log.columns, *[f"CASE WHEN valid THEN _act.{n} END AS {n}" for n in FIELDS], "valid"))


def split_valid(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed actions, dead letters)."""
    return actions.filter("valid"), actions.filter("NOT valid")


def is_json(value: str) -> str:
    return f"(try_parse_json({value}) IS NOT NULL AND {_alone(value)})"


def _trimmed(value: str) -> str:
    return f"btrim({value}, {text(BLANKS)})"


def _without_tag(part: str) -> str:
    return f"CASE WHEN startswith({part}, 'json') THEN {_trimmed(f'substring({part}, 5)')} ELSE {part} END"


def recovered_json(value: str) -> Column:
    """The first piece of the text that parses as JSON, '{}' when none does.

    Tried in order: every piece between fences, the whole text, the first flat
    ``{...}``.
    """
    pieces = f"transform(transform(split(whole, '{FENCE}', -1), p -> {_trimmed('p')}), p -> {_without_tag('p')})"
    fenced = f"CASE WHEN contains(whole, '{FENCE}') THEN try_element_at(filter({pieces}, p -> {is_json('p')}), 1) END"
    flat = f"regexp_extract(whole, {text(FLAT_OBJECT)}, 0)"
    tried = (f"coalesce({fenced}, CASE WHEN {is_json('whole')} THEN whole END, "
             f"CASE WHEN {is_json(flat)} THEN {flat} END, '{{}}')")
    return F.expr(bind(_trimmed(value), "whole", tried))


def unfenced_json(value: str) -> Column:
    """Text of a leading fenced block (or the text itself); NULL if not JSON."""
    block = _trimmed(bind(f"try_element_at(split(whole, '{FENCE}', -1), 2)", "p", _without_tag("p")))
    inner = f"CASE WHEN startswith(whole, '{FENCE}') THEN {block} ELSE whole END"
    return F.expr(bind(_trimmed(value), "whole", bind(inner, "body", f"CASE WHEN {is_json('body')} THEN body END")))


def embedded_action(value: str) -> Column:
    """From the first ``{`` to the last ``}``; the whole text without braces."""
    found = f"regexp_extract({value}, {text(OUTER_OBJECT)}, 0)"
    return F.expr(f"coalesce(nullif({found}, ''), {value})")
