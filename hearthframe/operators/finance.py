"""Buyer and seller arithmetic as columns: one row per buyer, seller or pair with a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.functions import measures as M
from hearthframe.operators.quality import reason_list
from hearthframe.session import spread

MONEY = "decimal(18,2)"
TOP_PRICE = 10_000_000


def money(c: Column | str | float) -> Column:
    """Cents, halves away from zero. Doubles go through their shortest decimal text."""
    c = F.col(c) if isinstance(c, str) else F.lit(c) if not isinstance(c, Column) else c
    return F.round(c.cast("decimal(28,10)"), 2).cast(MONEY)


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def stamp_duty(base: Column) -> Column:
    """Marginal bands, floored to whole units, at least 1 on a positive base."""
    total, start = F.lit(0).cast("decimal(20,4)"), 0
    for width, rate in K.DUTY_BANDS:
        part = F.greatest(base - F.lit(start).cast(MONEY), zero())
        if width is not None:
            part = F.least(part, F.lit(width).cast(MONEY))
            start += width
        total = total + part * F.lit(rate).cast("decimal(4,2)")
    return F.when(base > 0, F.greatest(F.lit(1), F.floor(total))).otherwise(F.lit(0)).cast(MONEY)


def monthly_payment(principal: Column, rate_pct: Column, years: Column) -> Column:
    return money(M.annuity(principal, rate_pct / 100, years))


FEES = ("renovation", "legal", "valuation_fee", "insurance", "moving", "other_upfront")
BUYER_DEFAULTS = {
    "ltv_limit_pct": None, "bank_minimum_cash_pct": None, "loan_amount": None, "cpf_available": 0.0, "cpf_limit": None,
    "absd_pct": 0.0, "annual_rate_pct": 0.0, "loan_years": 25, "income": 0.0, "monthly_budget": None, "other_monthly": 0.0,
    "other_debt": None, "option_deposit": 0.0, "cash_available": 0.0, **{f: 0.0 for f in FEES},
}


def with_buyer_defaults(df: DataFrame) -> DataFrame:
    out = df
    for name, value in BUYER_DEFAULTS.items():
        fallback = F.lit(None).cast("double") if value is None else F.lit(value)
        out = out.withColumn(name, F.coalesce(F.col(name), fallback) if name in df.columns else fallback)
    return out


def buyer_columns(price: Column, value: Column, use_requested_loan: bool = True) -> dict[str, Column]:
    """Named results of one purchase; ``price`` and ``value`` are money columns."""
    kind = F.col("loan_type")
    base = F.least(price, value)
    default_ltv = F.when((kind == "bank") & (F.col("loan_years") > 25), 55.0).otherwise(75.0)
    ltv_pct = F.coalesce(F.col("ltv_limit_pct"), default_ltv)
    ltv = (ltv_pct.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(8,4)")
    max_loan = F.when(kind == "none", zero()).otherwise(F.round(base * ltv, 2).cast(MONEY))
    loan = max_loan
    if use_requested_loan:
        loan = F.when(kind == "none", zero()).otherwise(F.coalesce(money("loan_amount"), max_loan))
    cash_pct = F.coalesce(F.col("bank_minimum_cash_pct"), F.when(ltv_pct <= 55, 10.0).otherwise(5.0))
    cash_rate = (cash_pct.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(8,4)")
    bank_cash = F.when(kind == "bank", F.round(base * cash_rate, 2).cast(MONEY)).otherwise(zero())
    available = money("cpf_available")
    cap = F.when(F.col("cpf_limit").isNotNull(), F.least(available, money("cpf_limit"))).otherwise(available)
    cpf = F.least(cap, F.greatest(zero(), base - loan - bank_cash)).cast(MONEY)
    cash_price = (price - loan - cpf).cast(MONEY)
    duty_base = F.greatest(price, value)
    duty = stamp_duty(duty_base)
    absd_rate = (F.col("absd_pct").cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(8,4)")
    absd = F.greatest(F.lit(0), F.floor(duty_base * absd_rate)).cast(MONEY)
    fees = zero()
    for f in FEES:
        fees = (fees + money(f)).cast(MONEY)
    cash_total = (cash_price + duty + absd + fees).cast(MONEY)
    payment = F.when(loan > 0, monthly_payment(loan, F.col("annual_rate_pct"), F.col("loan_years"))).otherwise(zero())
    outflow = (payment + money("other_monthly")).cast(MONEY)
    income = money("income")
    return {
        "cash_over_value": F.greatest(zero(), price - value).cast(MONEY), "max_loan": max_loan, "loan_used": loan, "cpf_used": cpf,
        "cash_for_price": cash_price, "bank_minimum_cash": bank_cash, "stamp_duty": duty, "additional_duty": absd,
        "initial_cash": cash_total, "initial_cash_and_cpf": (cash_total + cpf).cast(MONEY),
        "cash_after_deposit": (cash_total - money("option_deposit")).cast(MONEY),
        "cash_shortfall": F.greatest(zero(), cash_total - money("cash_available")).cast(MONEY),
        "monthly_payment": payment, "monthly_outflow": outflow,
        "payment_to_income_pct": F.when(income > 0, F.round(F.try_divide(outflow * 100, income), 2).cast("double")),
        "ratio_30_pass": F.when((income > 0) & (loan > 0), payment <= income * F.lit("0.30").cast("decimal(3,2)")),
        "ratio_55_pass": F.when((income > 0) & (kind == "bank") & F.col("other_debt").isNotNull(),
                                payment + money("other_debt") <= income * F.lit("0.55").cast("decimal(3,2)")),
        "within_budget": F.when(F.col("monthly_budget").isNotNull(), outflow <= money("monthly_budget")),
        "within_cash": cash_total <= money("cash_available"),
        "five_year_outflow": (cash_total + cpf + outflow * 60).cast(MONEY),
    }


def buyer_scenarios(df: DataFrame, price: str, value: str) -> DataFrame:
    """Each row (a buyer with a price) plus the scenario's results."""
    out = with_buyer_defaults(df)
    return out.select("*", *[c.alias(n) for n, c in buyer_columns(money(price), money(value)).items()])


def scenario_problems(price: str, value: str) -> Column:
    """Rules that need the computed scenario: loan above its ceiling, deposit above the cash part."""
    c = buyer_columns(money(price), money(value))
    return reason_list([
        ((F.col("loan_type") != "none") & F.coalesce(money("loan_amount") > c["max_loan"], F.lit(False)), "loan above planning ceiling"),
        (money("option_deposit") > c["cash_for_price"], "deposit above cash portion")])


def affordability_ceiling(df: DataFrame) -> DataFrame:
    """Largest whole price whose cash and monthly outflow fit; bisection as a fold inside the row."""
    base = with_buyer_defaults(spread(df)).withColumn("option_deposit", F.lit(0.0))
    budget, cash = money("monthly_budget"), money("cash_available")

    def fits(price: Column) -> Column:
        c = buyer_columns(price.cast(MONEY), price.cast(MONEY), use_requested_loan=False)
        return (c["initial_cash"] <= cash) & (c["monthly_outflow"] <= budget)

    def step(state: Column, _: Column) -> Column:
        low, high = state["lo"], state["hi"]
        middle = F.floor((low + high + 1) / 2)
        ok = fits(middle)
        return F.when(low >= high, state).otherwise(F.struct(
            F.when(ok, middle).otherwise(low).alias("lo"), F.when(ok, high).otherwise(middle - 1).alias("hi")))
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(TOP_PRICE).cast("bigint").alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step)["lo"]
    return base.withColumn("ceiling_price", F.when(F.col("monthly_budget").isNotNull(), found))


def sensitivity(df: DataFrame, price: str, value: str) -> DataFrame:
    """One-factor changes: rate by a point, term by five years, renovation by 10 000."""
    b = with_buyer_defaults(df)
    kind, years, rate, fix = F.col("loan_type"), F.col("loan_years"), F.col("annual_rate_pct"), F.col("renovation")
    top = F.when(kind == "hdb", 25).otherwise(30)

    def case(name: str, when: Column, r: Column = rate, y: Column = years, f: Column = fix) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("case"), r.cast("double").alias("r"), y.cast("int").alias("y"), f.cast("double").alias("f")))
    borrowing = kind != "none"
    crosses_down = (kind == "bank") & (years > 25) & (years - 5 <= 25)
    cases = F.array_compact(F.array(
        case("interest_rate_minus_1pp", borrowing, r=F.greatest(F.lit(0.0), rate - 1)),
        case("interest_rate_plus_1pp", borrowing & (rate < 100), r=F.least(F.lit(100.0), rate + 1)),
        case("loan_term_minus_5y", borrowing & (years > 5) & ~crosses_down, y=years - 5),
        case("loan_term_plus_5y", borrowing & (years + 5 <= top) & ~((kind == "bank") & (years <= 25)), y=years + 5),
        case("renovation_plus_10000", F.lit(True), f=fix + 10000),
        case("renovation_minus_10000", fix >= 10000, f=fix - 10000)))
    x = b.withColumn("__c", F.explode(cases)).withColumn("case", F.col("__c.case")).withColumn("annual_rate_pct", F.col("__c.r")) \
        .withColumn("loan_years", F.col("__c.y")).withColumn("renovation", F.col("__c.f")).drop("__c")
    c = buyer_columns(money(price), money(value))
    return x.select("*", *[c[n].alias(n) for n in ("initial_cash", "monthly_outflow", "cash_shortfall")])


def proceeds(df: DataFrame) -> DataFrame:
    """Sale price to loan, savings refund, fees and cash in three price scenarios.

    Needs expected_price, loan, refund, fees; optional conservative_price,
    optimistic_price, next_home_cash, next_home_cpf.
    """
    out = df
    for name in ("conservative_price", "optimistic_price", "next_home_cash", "next_home_cpf"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    expected = money("expected_price")
    factor = {"conservative": ("conservative_price", "0.95"), "optimistic": ("optimistic_price", "1.05")}

    def price(name: str) -> Column:
        column, f = factor[name]
        return F.coalesce(money(column), F.round(expected * F.lit(f).cast("decimal(4,2)"), 2).cast(MONEY))
    prices = F.array(F.struct(F.lit("conservative").alias("scenario"), price("conservative").alias("sale_price")),
                     F.struct(F.lit("expected").alias("scenario"), expected.alias("sale_price")),
                     F.struct(F.lit("optimistic").alias("scenario"), price("optimistic").alias("sale_price")))
    x = out.select("*", F.inline(prices))
    loan, refund, fees = money("loan"), money("refund"), money("fees")
    paid = F.least(F.col("sale_price"), loan)
    after_loan = F.col("sale_price") - paid
    refunded = F.least(after_loan, refund)
    after_refund = after_loan - refunded
    fees_paid = F.least(after_refund, fees)
    cash = after_refund - fees_paid
    results = {
        "loan_paid": paid, "loan_top_up": loan - paid, "refund_paid": refunded, "refund_shortfall": refund - refunded,
        "fees_paid": fees_paid, "fees_top_up": fees - fees_paid, "cash_proceeds": cash,
        "cash_gap_to_next_home": cash - money("next_home_cash"), "refund_gap_to_next_home": refunded - money("next_home_cpf")}
    return x.select("*", *[c.cast(MONEY).alias(n) for n, c in results.items()])


def buyer_problems() -> Column:
    """Broken input rules of a buyer row (missing optional fields are fine)."""
    kind, years = F.col("loan_type"), F.col("loan_years")
    limit = F.when((kind == "bank") & (years > 25), 55.0).otherwise(75.0)
    chosen = F.coalesce(F.col("ltv_limit_pct"), limit)
    floor_pct = F.when(chosen <= 55, 10.0).otherwise(5.0)
    low, high = F.col("fair_value_lower"), F.col("fair_value_upper")

    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    return reason_list([
        (~true(kind.isin("hdb", "bank", "none")), "loan_type"), (~true(F.col("value_status").isin("official", "assumed")), "value_status"),
        (~true((F.col("asking_price") > 0) & (F.col("official_value") > 0)), "price_or_value_not_positive"),
        (true(~F.col("absd_pct").between(0, 100)), "absd_pct"), (true(~F.col("annual_rate_pct").between(0, 100)), "annual_rate_pct"),
        (true((kind != "none") & ~years.between(1, F.when(kind == "hdb", 25).otherwise(30))), "loan_years"),
        (true((kind != "none") & (F.col("ltv_limit_pct") > limit)), "ltv_above_ceiling"),
        (true((kind != "bank") & F.col("bank_minimum_cash_pct").isNotNull()), "bank_cash_without_bank_loan"),
        (true((kind == "bank") & (F.col("bank_minimum_cash_pct") < floor_pct)), "bank_cash_too_low"),
        (true((kind == "none") & (F.coalesce(F.col("loan_amount"), F.lit(0.0)) != 0)), "loan_without_type"),
        (true((kind == "none") & F.col("ltv_limit_pct").isNotNull()), "ltv_without_loan"),
        (true(F.col("option_deposit") > 5000), "deposit_above_limit"),
        (true(low.isNull() != high.isNull()) | true(low > high), "fair_range")])


def seller_problems() -> Column:
    """Broken input rules of a seller row."""
    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    e, lo, hi = F.col("expected_price"), F.col("conservative_price"), F.col("optimistic_price")
    return reason_list([
        (~true(e > 0), "expected_price"), (true(lo > e) | true(hi < e) | true(lo <= 0), "price_order"),
        (~true(F.col("loan") >= 0), "loan"), (~true(F.col("refund") >= 0), "refund"), (true(F.col("fees") < 0), "fees"),
        (F.col("next_home_cash").isNull() != F.col("next_home_cpf").isNull(), "next_home_pair")])


def range_position(asking: Column, low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), F.lit(None)).when(asking < low, "below").when(asking > high, "above").otherwise("within")
