"""Scans that evaluate only what changed, against full scans."""

from govaudit.operators import rescan, scan
from govaudit.operators.rules import REGISTRY, phrase_rule, with_rule

NONE = "packet_id BIGINT, digest BINARY, message STRING"


def packets(spark, rows):
    return spark.createDataFrame([(i, {"product_spec.md": spec, "eval_report.json": report} if spec is not None else {}) for i, spec, report in rows],
                                 "packet_id BIGINT, artifacts MAP<STRING, STRING>")


def verdicts(df):
    return sorted((str(r.packet_id), r.ord, r.code, r.passed, r.message) for r in df.collect())


def test_only_what_changed_is_evaluated(spark):
    rows = [(k, f"reads admin actions {k}", "toxicity and bias") for k in range(300)]
    full = packets(spark, rows)
    first = rescan.rescan(full, spark.createDataFrame([], NONE)).cache()
    assert verdicts(first) == verdicts(scan.all_checks(full)) and first.where("evaluated").count() == 300 * len(REGISTRY)
    assert rescan.evaluated(full, first).count() == 0
    # three reports change: the one rule that reads them, nothing else
    later = packets(spark, [(k, s, "nothing here" if k in (5, 6, 7) else r) for k, s, r in rows])
    again = rescan.rescan(later, first)
    assert verdicts(again) == verdicts(scan.all_checks(later))
    assert sorted((r.packet_id, r.code) for r in again.where("evaluated").collect()) == [(k, "EVAL-008") for k in (5, 6, 7)]
    # a rule of another phrase is another rule
    more, other = (with_rule("OWN-1", phrase_rule("product_spec.md", word, "OWN-1: found")) for word in ("admin", "blue"))
    mine = rescan.rescan(full, first, more)
    assert verdicts(mine) == verdicts(scan.all_checks(full, more))
    assert {r.code for r in mine.where("evaluated").collect()} == {"OWN-1"}
    assert rescan.evaluated(full, mine, other).count() == 300 and rescan.evaluated(full, mine, more).count() == 0


def test_awkward_packets(spark):
    """Ids that repeat with equal and other texts, rows without id, packets without artifacts, no packets."""
    rows = [(1, "admin", "bias"), (1, "admin", "bias"), (1, "write access", ""), (None, "admin", None), (None, None, None), (2, "", "")]
    some = packets(spark, rows)
    first = rescan.rescan(some, spark.createDataFrame([], NONE)).cache()
    assert verdicts(first) == verdicts(scan.all_checks(some))
    later = packets(spark, [*rows, (1, "action", ""), (3, "x", "y")])
    again = rescan.rescan(later, first)
    assert verdicts(again) == verdicts(scan.all_checks(later))
    assert {r.packet_id for r in again.where("evaluated").collect()} == {1, 3}
    # the new row's report is that of another row of its id: only the rules that read its spec had to look
    readers = {code for code, rule in REGISTRY.items() if "product_spec.md" in rescan._identity(rule)[1]}
    assert {r.code for r in again.where("packet_id = 1 AND evaluated").collect()} == readers
    assert rescan.rescan(some.limit(0), first).collect() == []
