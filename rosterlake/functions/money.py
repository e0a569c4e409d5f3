"""Exact money: brackets, scenarios, bounds, currencies. DECIMAL throughout; HALF_UP to cents."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (lower, upper or None, rate).
Bracket = tuple[Decimal, Decimal | None, Decimal]
_EXACT = "decimal(38,10)"
#: Monthly share of pay by the unit that it is stated for.
MONTHLY_FACTOR = {"hour": 173.333, "day": 21.666, "week": 4.333, "month": 1.0, "year": 1.0 / 12.0}


def brackets(rows: Sequence[tuple[object, object, object]]) -> list[Bracket]:
    """Checked brackets: from 0, contiguous, rates of 0 to 1, the last one open."""
    out = [(Decimal(str(a)), None if b is None else Decimal(str(b)), Decimal(str(r))) for a, b, r in rows]
    edge: Decimal | None = Decimal(0)
    for lower, upper, rate in out:
        if edge is None or lower != edge or not 0 <= rate <= 1 or (upper is not None and upper <= lower):
            raise ValueError(f"brackets must be contiguous from 0 with rates of 0 to 1: {(lower, upper, rate)}")
        edge = upper
    if not out or edge is not None:
        raise ValueError("the last bracket must be open")
    return out


def money(x: Column) -> Column:
    return F.round(x.cast("decimal(38,12)"), 2)


def rate(x: Column) -> Column:
    return F.round(x.cast("decimal(38,12)"), 6)


def progressive_tax(income: Column, table: Sequence[Bracket]) -> Column:
    """Tax by marginal brackets; 0 for an income of 0 or less."""
    x = income.cast("decimal(28,6)")
    total = F.lit(0).cast("decimal(38,10)")
    for lower, upper, r in table:
        part = F.greatest(x - F.lit(lower).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
        if upper is not None:
            part = F.least(part, F.lit(upper - lower).cast("decimal(28,6)"))
        total = total + (part.cast("decimal(24,6)") * F.lit(r).cast("decimal(8,6)")).cast(_EXACT)
    return total


def marginal_rate(income: Column, table: Sequence[Bracket]) -> Column:
    """The rate on the last unit of income."""
    x = income.cast("decimal(28,6)")
    out = F.lit(Decimal(0)).cast("decimal(8,6)")
    for lower, upper, r in table:
        within = x > F.lit(lower).cast("decimal(28,6)")
        if upper is not None:
            within = within & (x <= F.lit(upper).cast("decimal(28,6)"))
        out = F.when(within, F.lit(r).cast("decimal(8,6)")).otherwise(out)
    return F.when(x <= 0, F.lit(Decimal(0)).cast("decimal(8,6)")).otherwise(out)


def month_weighted_rate(periods: Sequence[tuple[int, int, object]]) -> Decimal:
    """Mean rate of (first month, last month, rate) periods, which must cover a year."""
    months = [b - a + 1 for a, b, _ in periods]
    if any(m <= 0 for m in months) or sum(months) != 12:
        raise ValueError("periods must cover all 12 months")
    return sum((Decimal(str(r)) * m for (_, _, r), m in zip(periods, months, strict=True)), Decimal(0)) / 12


def scenario(monthly_base: Column, *, table: Sequence[Bracket], allowance: Column | None = None, guaranteed_months: object = 0, variable_share: object = 0, relief: object = 0, employee_rate: object = 0, employer_rate: object = 0, cap: object | None = None, include_bonus: bool = True, deductible: bool = False, fx: object = 1) -> dict[str, Column]:
    """A year's pay by rule: gross, contributions, tax and net cash, with and without the variable bonus.

    Without the variable bonus, contributions and tax are worked out anew, not
    subtracted. Amounts are rounded HALF_UP to cents at the end only.
    """
    wide = lambda c: c.cast("decimal(28,6)")
    fixed = lambda v: F.lit(Decimal(str(v))).cast("decimal(12,6)")
    times = lambda a, b: (a.cast("decimal(24,6)") * b).cast("decimal(28,6)")
    base = wide(times(monthly_base, fixed(12)))
    extra = wide(times(allowance, fixed(12))) if allowance is not None else wide(F.lit(0))
    guaranteed = times(monthly_base, fixed(guaranteed_months))
    variable = times(base, fixed(variable_share))
    gross = wide(base + extra + guaranteed + variable)

    def net(total: Column) -> dict[str, Column]:
        counted = total if include_bonus else wide(base + extra)
        if cap is not None:
            counted = F.least(counted, wide(F.lit(Decimal(str(cap)))))
        paid = times(counted, fixed(employee_rate))
        taxable = F.greatest(wide(F.lit(0)), wide(total - wide(F.lit(Decimal(str(relief)))) - (paid if deductible else wide(F.lit(0)))))
        tax = progressive_tax(taxable, table)
        return {"counted": counted, "paid": paid, "taxable": taxable, "tax": tax, "net": total - paid - tax}

    full, lean = net(gross), net(wide(gross - variable))
    employer = times(full["counted"], fixed(employer_rate))
    return {
        "annual_base": money(base),
        "guaranteed_bonus": money(guaranteed),
        "variable_bonus": money(variable),
        "gross_annual_cash": money(gross),
        "gross_monthly_cash": money((gross - variable) / 12),
        "employee_contribution": money(full["paid"]),
        "employer_contribution": money(employer),
        "taxable_income": money(full["taxable"]),
        "estimated_income_tax": money(full["tax"]),
        "marginal_income_tax_rate": rate(marginal_rate(full["taxable"], table)),
        "net_annual_cash": money(full["net"]),
        "net_annual_cash_ex_variable": money(lean["net"]),
        "net_monthly_cash": money(full["net"] / 12),
        "total_employer_cost": money(gross + employer),
        "net_annual_reporting": money(full["net"].cast("decimal(28,8)") * F.lit(Decimal(str(fx))).cast("decimal(10,6)")),
    }


def fx_rate(base: Column, quote: Column, pairs: dict[tuple[str, str], float]) -> Column:
    """1 for equal currencies, else the pair's rate, else the reciprocal of the reverse pair's, else null."""
    out = F.lit(None).cast("double")
    for (b, q), r in pairs.items():
        if (q, b) not in pairs:
            out = F.when((base == q) & (quote == b), F.lit(1.0 / r)).otherwise(out)
    for (b, q), r in pairs.items():
        out = F.when((base == b) & (quote == q), F.lit(float(r))).otherwise(out)
    return F.when(base == quote, F.lit(1.0)).otherwise(out)


def salary_bound(text: Column) -> Column:
    """A number of 0 or more written plainly or with thousands commas; else null."""
    t = F.trim(text)
    plain = t.rlike(r"^(?:\d{1,3}(?:,\d{3})+(?:\.\d*)?|\d+(?:\.\d*)?|\.\d+)$")
    return F.when(plain, F.regexp_replace(t, ",", "").try_cast("double"))


def monthly_range(low: Column, high: Column, unit: Column) -> tuple[Column, Column]:
    """(low, high) a month; a missing end takes the other; unknown units count as months."""
    factor = F.lit(1.0)
    for name, f in MONTHLY_FACTOR.items():
        factor = F.when(F.lower(F.trim(unit)) == name, F.lit(f)).otherwise(factor)
    a, b = F.coalesce(low, high), F.coalesce(high, low)
    return F.least(a, b) * factor, F.greatest(a, b) * factor


def salary_match(low: Column, high: Column, minimum: float | None, maximum: float | None, include_missing: bool = False) -> Column:
    """inactive, match, mismatch, unknown or match_missing: whether two ranges overlap. Currency is not looked at."""
    if minimum is None and maximum is None:
        return F.lit("inactive")
    out = F.when(low.isNull() | high.isNull(), "match_missing" if include_missing else "unknown")
    if minimum is not None:
        out = out.when(high < minimum, "mismatch")
    if maximum is not None:
        out = out.when(low > maximum, "mismatch")
    return out.otherwise("match")


def clamp_percent(x: Column, default: int = 0) -> Column:
    """A whole number of 0 to 100, halves to even."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x.cast("double")))).cast("int"), F.lit(default))


def first_positive(*values: Column) -> Column:
    """The first counter over 0, else 0."""
    return F.coalesce(*(F.when(v > 0, v) for v in values), F.lit(0))


def currency_of(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The code whose alias stands first in the text; of several at one place the longest alias; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.array_compact(F.array(*(F.when(F.instr(low, a.lower()) > 0, F.struct(F.instr(low, a.lower()).alias("at"), F.lit(-len(a)).alias("n"), F.lit(code).alias("code"))) for a, code in aliases)))
    return F.array_min(at)["code"]
