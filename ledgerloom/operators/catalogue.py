"""Rules and programmes as tables: conditions are rows, read as expressions when a plan is made.

A rule is (rule_id, programme, needs, passes, otherwise): the facts it needs, a condition over them in SQL's expression
language, and its status where the condition is false. Rules may come from any table of the session, so one that is added
as a row takes part without a change of code; they go into the plan, and a table of facts is read once for all of them.

A programme's status is the worst of its rules'; an assertion's is the worst of the programmes that its goal's row of the
matrix names, and it is not tested while one of them has no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one plan may hold; more are an error, none is left out.
MOST_RULES = 1000


class Rule(NamedTuple):
    rule_id: str
    programme: str
    needs: str
    passes: str
    otherwise: str = "FAIL"


# The rules that are there from the start. Facts: order_, receipt_, invoice_ quantities, amounts and dates.
RULES = (
    Rule("required_docs_present", "evidence_chain", "order_count, receipt_count, invoice_count", "order_count > 0 AND receipt_count > 0 AND invoice_count > 0", "WARNING"),
    Rule("required_fields_present", "evidence_chain", "order_count", "order_amount IS NOT NULL AND posting_date IS NOT NULL", "WARNING"),
    Rule("docs_same_business", "relations_gate4", "foreign_count", "foreign_count = 0"),
    Rule("qty_order_vs_receipt", "three_way", "order_quantity, receipt_quantity", "abs(order_quantity - receipt_quantity) <= 0.01 * greatest(abs(order_quantity), abs(receipt_quantity))"),
    Rule("qty_receipt_vs_invoice", "three_way", "receipt_quantity, invoice_quantity", "abs(receipt_quantity - invoice_quantity) <= 0.01 * greatest(abs(receipt_quantity), abs(invoice_quantity))"),
    Rule("amount_order_vs_invoice", "three_way", "order_amount, invoice_amount", "abs(order_amount - invoice_amount) <= 0.02 * greatest(abs(order_amount), abs(invoice_amount))"),
    Rule("date_order_ship_receipt_posting", "three_way_cutoff", "receipt_date, posting_date", "date_trunc('YEAR', receipt_date) = date_trunc('YEAR', posting_date)"),
)
# Goal, assertion, programmes, what a passed assertion does not say.
MATRIX = (
    ("gospd01010", "occurrence", ("evidence_chain", "relations_gate4", "three_way"), "不能仅凭账至证证明总体完整性"),
    ("gospd01010", "accuracy", ("amount_test", "three_way"), "推导数量不得当作原始签收数量"),
    ("gospd01010", "cutoff", ("three_way_cutoff",), "付款账期不是收入确认时点"),
    ("gospd01010", "contract_clarity", ("contract_terms",), "歧义输出 WARNING，不直接等同已证实错报"),
    ("gospd01030", "cutoff", ("evidence_chain", "relations_gate4", "three_way_cutoff"), "未配置 period_end 或 Gate4 未确认时不得出正式期间结论"),
    ("gospd01030", "occurrence_sample", ("evidence_chain", "relations_gate4"), "不形成抽样总体结论；未确认链不进底稿"),
    ("gospd01030", "ar_period", ("three_way_cutoff",), "当前与收入期间同判；独立应收函证/坏账不在本表范围"),
    ("gospd01010_2", "performance_obligation", ("evidence_chain", "contract_terms"), "不强制金额与三单"),
    ("gospd01010_3", "transaction_price", ("evidence_chain", "contract_terms", "amount_test"), "不强制三单/截止"),
    ("gospd01010_4", "ssp_allocation", ("evidence_chain", "contract_terms", "amount_test"), "不强制三单/截止"),
)
# Statuses, the worst first.
WORST = ("FAIL", "WARNING", "NOT_TESTED", "PASS")


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table with the columns of Rule, which is a configuration and small."""
    rows = table.select(*Rule._fields).orderBy("rule_id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return [Rule(*r) for r in rows]


def status_of(rule: Rule) -> Column:
    """A rule's status on a row of facts: not tested while a fact it needs is missing."""
    missing = " OR ".join(f"{c.strip()} IS NULL" for c in rule.needs.split(",") if c.strip()) or "false"
    passes = F.coalesce(F.expr(rule.passes), F.lit(False))
    return F.when(F.expr(missing), "NOT_TESTED").when(passes, "PASS").otherwise(rule.otherwise)


def evaluate(facts: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(keys, rule_id, programme, status), a row for each rule. A rule with a fact that the table does not have, a condition
    that cannot be read, an unknown status or a name that occurs twice is an error that names the rule."""
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    for r in rules:
        if r.otherwise not in WORST:
            raise ValueError(f"rule {r.rule_id}: no status {r.otherwise}")
        try:
            facts.select(status_of(r)).schema  # noqa: B018 - read while the plan is made
        except Exception as e:
            raise ValueError(f"rule {r.rule_id} cannot be read: {e}") from e
    made = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.programme).alias("programme"), status_of(r).alias("status")) for r in rules))
    return facts.select(*keys, F.explode(made).alias("r")).select(*keys, "r.*")


def _worst(status: Column) -> Column:
    """Of a group's statuses."""
    return F.element_at(F.array(*map(F.lit, WORST)), F.min(F.array_position(F.array(*map(F.lit, WORST)), status)).cast("int"))


def programmes(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, programme, status) of the results of rules."""
    return results.groupBy(*keys, "programme").agg(_worst(F.col("status")).alias("status"))


def programme_matrix(goals: DataFrame, results: DataFrame, keys: Sequence[str], matrix: Sequence[tuple[str, str, Sequence[str], str]] = MATRIX) -> DataFrame:
    """(keys, goal, assertion, status, untested, cannot_claim) of every chosen goal's assertions. goals: (keys, goal), a
    goal chosen twice counts once, one that the matrix does not have gives nothing; results: (keys, programme, status);
    untested: the programmes without a result, in order."""
    spark = goals.sparkSession
    rows = spark.createDataFrame([(g, i, a, list(p), c) for i, (g, a, p, c) in enumerate(matrix)], "goal string, place int, assertion string, programmes array<string>, cannot_claim string")
    asked = goals.select(*keys, "goal").distinct().join(F.broadcast(rows), "goal")  # the matrix is a configuration
    each = asked.select(*keys, "goal", "place", "assertion", "cannot_claim", F.explode("programmes").alias("programme"))
    both = each.join(programmes(results, keys), [*keys, "programme"], "left")
    status = F.coalesce("status", F.lit("NOT_TESTED"))
    none = F.array_sort(F.collect_set(F.when(status == "NOT_TESTED", F.col("programme"))))
    return both.groupBy(*keys, "goal", "place", "assertion", "cannot_claim").agg(_worst(status).alias("status"), F.array_join(none, ",").alias("untested")).select(*keys, "goal", "assertion", "status", "untested", "cannot_claim")
