"""Deterministic calculations over typed facts, with guards that are checked in a fixed order and verdicts.

Facts are rows (filing, fact_key, raw_value, unit, verified, period_start, period_end). ``paired`` turns the keys that
a calculation needs into columns of one row a filing, with how often each key occurs, by conditional aggregation: one
shuffle, partial sums before it, whatever the number of keys.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, NOT_CALCULABLE, NOT_COMPARABLE = "MATCH", "MISMATCH", "NOT_CALCULABLE", "NOT_COMPARABLE"
EXACT = "decimal(20,0)"
MOST_DECIMALS = 6


def paired(facts: DataFrame, filing: str, keys: tuple[str, ...]) -> DataFrame:
    """filing, and for each key k: k (raw value), k_n, k_unit, k_ok (all verified), k_from, k_to."""
    aggregates = []
    for k in keys:
        own = F.col("fact_key") == k
        aggregates += [
            F.max(F.when(own, F.col("raw_value"))).alias(k),
            F.count_if(own).alias(f"{k}_n"),
            F.max(F.when(own, F.col("unit"))).alias(f"{k}_unit"),
            F.bool_and(F.when(own, F.col("verified"))).alias(f"{k}_ok"),
            F.max(F.when(own, F.col("period_start"))).alias(f"{k}_from"),
            F.max(F.when(own, F.col("period_end"))).alias(f"{k}_to"),
        ]
    return facts.where(F.col("fact_key").isin(*keys)).groupBy(filing).agg(*aggregates)


def _guard(units: dict[str, str]) -> Column:
    """The first reason why the keys can't be used, or null."""
    reasons = [
        ("duplicate fact", reduce(or_, [F.col(f"{k}_n") > 1 for k in units])),
        ("missing fact", reduce(or_, [F.col(f"{k}_n") == 0 for k in units])),
        ("unverified fact", reduce(or_, [~F.coalesce(F.col(f"{k}_ok"), F.lit(False)) for k in units])),
        ("unit", reduce(or_, [~F.col(f"{k}_unit").eqNullSafe(F.lit(u)) for k, u in units.items()])),
    ]
    return F.coalesce(*[F.when(test, name) for name, test in reasons])


def same_period(a: str, b: str) -> Column:
    return F.col(f"{a}_from").eqNullSafe(F.col(f"{b}_from")) & F.col(f"{a}_to").eqNullSafe(F.col(f"{b}_to"))


def decimals(raw: Column) -> Column:
    """Digits behind the point of a disclosed number."""
    return F.when(F.instr(raw, ".") > 0, F.length(F.substring_index(raw, ".", -1))).otherwise(0)


def rounded(value: Column, scale: Column) -> Column:
    """value to as many decimals as scale says, halves away from zero, as text with all of them."""
    out = F.round(value, 0).cast("decimal(38,0)").cast("string")
    for k in range(1, MOST_DECIMALS + 1):
        out = F.when(scale == k, F.round(value, k).cast(f"decimal(38,{k})").cast("string")).otherwise(out)
    return out


def ratio(facts: DataFrame, filing: str, part: str, whole: str, disclosed: str, money: str = "KRW", share: str = "PERCENT") -> DataFrame:
    """part / whole x 100 against the disclosed ratio, at the disclosed number's own scale (1 without it)."""
    rows = paired(facts, filing, (part, whole, disclosed))
    a, b, d = F.col(part).try_cast(EXACT), F.col(whole).try_cast(EXACT), F.col(disclosed)
    reason = F.coalesce(
        _guard({part: money, whole: money}),
        F.when(~same_period(part, whole), "period"),
        F.when(a.isNull() | b.isNull(), "unreadable value"),
        F.when(b == 0, "zero denominator"),
    )
    usable = (F.col(f"{disclosed}_n") == 1) & F.coalesce(F.col(f"{disclosed}_ok"), F.lit(False)) & F.col(f"{disclosed}_unit").eqNullSafe(F.lit(share)) & d.try_cast("decimal(20,6)").isNotNull()
    scale = F.when(usable, F.least(decimals(d), F.lit(MOST_DECIMALS))).otherwise(1)
    value = F.when(reason.isNull(), F.try_divide(a, b) * 100)
    out = rows.select(filing, reason.alias("reason"), rounded(value, scale).alias("display"), usable.alias("usable"), (b < 0).alias("negative"), d.try_cast("decimal(20,6)").alias("told"))
    verdict = (
        F.when(F.col("reason").isNotNull(), NOT_CALCULABLE)
        .when(F.col("negative") | ~F.col("usable"), NOT_COMPARABLE)
        .when(F.col("display").cast("decimal(20,6)") == F.col("told"), MATCH)
        .otherwise(MISMATCH)
    )
    return out.select(filing, verdict.alias("verdict"), "display", "reason")


def duration(facts: DataFrame, filing: str, start: str, end: str) -> DataFrame:
    """Days from start to end, both included."""
    rows = paired(facts, filing, (start, end))
    a, b = F.try_to_date(F.col(start), "yyyy-MM-dd"), F.try_to_date(F.col(end), "yyyy-MM-dd")
    reason = F.coalesce(_guard({start: "ISO_DATE", end: "ISO_DATE"}), F.when(a.isNull() | b.isNull(), "unreadable value"), F.when(b < a, "end before start"))
    days = F.when(reason.isNull(), F.date_diff(b, a) + 1)
    return rows.select(filing, F.when(reason.isNull(), NOT_COMPARABLE).otherwise(NOT_CALCULABLE).alias("verdict"), days.alias("days"), reason.alias("reason"))


def product(facts: DataFrame, filing: str, foreign: str, rate: str, amount: str, money: str = "KRW") -> DataFrame:
    """foreign x rate, rounded to whole units, against the amount."""
    rows = paired(facts, filing, (foreign, rate, amount))
    x, y, z = F.col(foreign).try_cast("decimal(18,2)"), F.col(rate).try_cast("decimal(10,2)"), F.col(amount).try_cast(EXACT)
    reason = F.coalesce(
        _guard({foreign: "USD", rate: f"{money}_PER_USD", amount: money}),
        F.when(x.isNull() | y.isNull() | z.isNull(), "unreadable value"),
        F.when((x <= 0) | (y <= 0), "not positive"),
    )
    value = F.when(reason.isNull(), F.round(x * y, 0).cast(EXACT))
    verdict = F.when(reason.isNotNull(), NOT_CALCULABLE).when(value == z, MATCH).otherwise(MISMATCH)
    return rows.select(filing, verdict.alias("verdict"), value.alias("product"), reason.alias("reason"))


def difference(facts: DataFrame, filing: str, amounts: tuple[str, str], dates: tuple[str, str], money: str = "KRW") -> DataFrame:
    """after - before for the one kind of pair, amounts or dates (days), that a filing has."""
    rows = paired(facts, filing, (*amounts, *dates))
    has = {kind: reduce(or_, [F.col(f"{k}_n") > 0 for k in pair]) for kind, pair in (("amount", amounts), ("date", dates))}
    a, b = (F.col(k).try_cast(EXACT) for k in amounts)
    c, d = (F.try_to_date(F.col(k), "yyyy-MM-dd") for k in dates)
    reason = F.coalesce(
        F.when(and_(*has.values()), "both kinds"),
        F.when(~or_(*has.values()), "missing fact"),
        F.when(has["amount"], _guard(dict.fromkeys(amounts, money))),
        F.when(has["date"], _guard(dict.fromkeys(dates, "ISO_DATE"))),
        F.when(has["amount"] & (a.isNull() | b.isNull()), "unreadable value"),
        F.when(has["date"] & (c.isNull() | d.isNull()), "unreadable value"),
    )
    amount = F.when(reason.isNull() & has["amount"], (b - a).cast(EXACT))
    days = F.when(reason.isNull() & has["date"], F.date_diff(d, c))
    return rows.select(filing, F.when(reason.isNull(), NOT_COMPARABLE).otherwise(NOT_CALCULABLE).alias("verdict"), amount.alias("amount_change"), days.alias("days_change"), reason.alias("reason"))


def change_rate(base: Column, new: Column) -> Column:
    """(new - base) / base x 100; null without either or for a base of zero."""
    return F.try_divide(new - base, F.nullif(base, F.lit(0))) * 100


def dilution(existing: Column, added: Column) -> Column:
    """Share of added units in all units afterwards, in percent."""
    return F.try_divide(added, F.nullif(existing + added, F.lit(0))) * 100


#: Units of money and what they stand for.
UNIT_FACTORS = {"원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}


def converted(amount: Column, source: Column, target: Column) -> Column:
    """amount in the target unit; null for unknown units."""
    factors = F.create_map(*[F.lit(x) for pair in UNIT_FACTORS.items() for x in pair])
    return F.try_divide(amount * F.try_element_at(factors, source), F.try_element_at(factors, target))


def same_basis_totals(facts: DataFrame, filing: str, key: str, unit: str) -> DataFrame:
    """Sum and average of a key's verified values by filing; null where units differ."""
    own = facts.where(F.col("fact_key") == key).withColumn("v", F.col("raw_value").try_cast(EXACT))
    ok = F.bool_and(F.col("verified") & F.col("unit").eqNullSafe(F.lit(unit)) & F.col("v").isNotNull())
    out = own.groupBy(filing).agg(F.sum("v").alias("total"), F.count("v").alias("n"), ok.alias("ok"))
    total = F.when(F.col("ok"), F.col("total"))
    return out.select(filing, total.alias("total"), F.when(F.col("ok"), F.round(F.try_divide(F.col("total").cast("decimal(38,0)"), F.col("n")), 2).cast("decimal(38,2)")).alias("average"), F.when(F.col("ok"), NOT_COMPARABLE).otherwise(NOT_CALCULABLE).alias("verdict"))
