"""Three-way comparison of order, receipt and invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT_TOLERANCE, QUANTITY_TOLERANCE, EXACT = 0.02, 0.01, 1e-9


def spread(*values: Column) -> Column:
    """(largest - smallest) / largest magnitude of the values there are; 0 where all are 0."""
    peak = F.greatest(*(F.abs(v) for v in values)) if len(values) > 1 else F.abs(values[0])
    return F.when(peak > 0, (F.greatest(*values) - F.least(*values)) / peak).otherwise(F.lit(0.0))


def _verdict(ratio: Column, width: Column, tolerance: float) -> Column:
    return F.when(width <= EXACT, "EQUAL").when(ratio <= tolerance, "SOFT").otherwise("HARD")


def amount_verdict(order: Column, receipt: Column, invoice: Column, tolerance: float = AMOUNT_TOLERANCE) -> Column:
    """EQUAL, SOFT (within the tolerance) or HARD. An amount of 0 or none is missing: without a receipt amount order and
    invoice are compared alone, and each of them must be there."""
    o, r, i = (F.coalesce(c, F.lit(0.0)) for c in (order, receipt, invoice))
    pair = _verdict(spread(o, i), F.abs(o - i), tolerance)
    three = _verdict(spread(o, r, i), F.greatest(o, r, i) - F.least(o, r, i), tolerance)
    return F.when(r > 0, three).when((o <= 0) | (i <= 0), "HARD").otherwise(pair)


def quantity_verdict(order: Column, receipt: Column, invoice: Column, tolerance: float = QUANTITY_TOLERANCE) -> Column:
    """As for amounts, over the quantities there are; NOT_TESTED with fewer than two."""
    got = [F.when(c > 0, c) for c in (order, receipt, invoice)]
    n = sum(F.when(g.isNotNull(), 1).otherwise(0) for g in got)
    return F.when(n < 2, "NOT_TESTED").otherwise(_verdict(spread(*got), F.greatest(*got) - F.least(*got), tolerance))


_SUFFIX = r"(co\.?,? ?ltd\.?|limited|inc\.?|llc|gmbh|corp\.?|有限责任公司|股份有限公司|有限公司|公司)$"


def party_name(c: Column) -> Column:
    """A name for comparison: without white space and punctuation, lower case, without the legal form."""
    plain = F.lower(F.regexp_replace(F.translate(c, "（）　", "() "), r"[\s()·,.\-]", ""))
    return F.regexp_replace(plain, _SUFFIX.replace(" ", "").replace(r"\.", r"\.?"), "")


def parties_agree(*names: Column) -> Column:
    """Whether all names are there and each is contained in, or contains, the longest."""
    normal = F.array(*(party_name(n) for n in names))
    longest = F.element_at(F.array_sort(F.transform(normal, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    there = F.forall(normal, lambda x: x.isNotNull() & (x != ""))
    return there & F.forall(normal, lambda x: F.contains(longest, x))


def decide(party_ok: Column, amount: Column, quantity: Column) -> tuple[Column, Column]:
    """Status and decision: the party first, then hard differences, then soft ones."""
    hard = ~party_ok | (amount == "HARD") | (quantity == "HARD")
    soft = (amount == "SOFT") | (quantity == "SOFT")
    status = F.when(hard, "FAIL").when(soft, "WARNING").otherwise("PASS")
    return status, F.when(hard, "HOLD_REVIEW").when(soft, "PASS_WITH_WARNING").otherwise("AUTO_PASS")


def three_way(docs: DataFrame, key: str = "business_id") -> DataFrame:
    """One row for each business from rows (business, role, party, qty, amount): verdicts, status and decision. A role's
    documents are added up in one grouping, not joined; the party is the least of the role's names."""
    side = lambda role, c, f: f(F.when(F.col("role") == role, F.col(c)))
    roles = ("order", "receipt", "invoice")
    wide = docs.groupBy(key).agg(
        *(side(r, "qty", F.sum).cast("double").alias(f"{r}_qty") for r in roles),
        *(side(r, "amount", F.sum).cast("double").alias(f"{r}_amount") for r in roles),
        *(side(r, "party", F.min).alias(f"{r}_party") for r in roles),
    )
    wide = wide.withColumns({
        "amount_verdict": amount_verdict(*(F.col(f"{r}_amount") for r in roles)),
        "quantity_verdict": quantity_verdict(*(F.col(f"{r}_qty") for r in roles)),
        "party_ok": F.coalesce(parties_agree(*(F.col(f"{r}_party") for r in roles)), F.lit(False)),
    })
    status, decision = decide(F.col("party_ok"), F.col("amount_verdict"), F.col("quantity_verdict"))
    return wide.withColumns({"status": status, "decision": decision})
