"""Finance queries (survey group K): buyers and sellers derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.operators import finance as N
from hearthframe.plans.registry import query
from hearthframe.sources.tables import table

_DUTY = ("CAST(CASE WHEN {b} > 0 THEN greatest(1, floor(least({b}, 180000)*0.01 + least(greatest({b}-180000,0),180000)*0.02 + least(greatest({b}-360000,0),640000)*0.03"
         " + least(greatest({b}-1000000,0),500000)*0.04 + least(greatest({b}-1500000,0),1500000)*0.05 + greatest({b}-3000000,0)*0.06)) ELSE 0 END AS DOUBLE)")


def sql_duty(b: str) -> str:
    return _DUTY.format(b=b)


@query("k1_progressive_band_tax", f"SELECT o_orderkey, {sql_duty('CAST(o_totalprice * 8 AS DECIMAL(18,2))')} AS duty FROM orders")
def _k1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.stamp_duty(N.money(F.col("o_totalprice") * 8)).cast("double").alias("duty"))


_PAY = "CASE WHEN p = 0 THEN 0 WHEN r = 0 THEN p / (y*12) ELSE p * r / (1 - power(1 + r, -(y*12)::DOUBLE)) END"


@query("k2_amortised_payment", f"SELECT o_orderkey, round({_PAY}, 6) AS payment FROM (SELECT o_orderkey, o_totalprice AS p, (o_custkey % 6) / 100.0::DOUBLE / 12 AS r, 5 + o_custkey % 25 AS y FROM orders)")
def _k2(spark, sf):
    from hearthframe.functions.measures import annuity
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(annuity(F.col("o_totalprice"), (k % 6) / 100.0, F.lit(5) + k % 25), 6).alias("payment"))


def buyers(spark, sf):
    """One buyer per order: the price is the order, the purse the customer."""
    k = F.col("o_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return o.join(c, "o_custkey").select(
        "o_orderkey", F.floor("o_totalprice").cast("double").alias("asking_price"), (F.floor(F.col("o_totalprice") * 0.95)).cast("double").alias("official_value"),
        F.when(k % 3 == 0, "bank").when(k % 3 == 1, "hdb").otherwise("none").alias("loan_type"), (F.lit(20) + k % 10).cast("int").alias("loan_years"),
        F.lit(3.0).alias("annual_rate_pct"), (k % 2 * 20).cast("double").alias("absd_pct"),
        (F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))) * 10).cast("double").alias("cpf_available"), F.lit(60000.0).alias("cpf_limit"),
        F.lit(100000.0).alias("cash_available"), F.lit(9000.0).alias("income"), F.lit(1500.0).alias("monthly_budget"), F.lit(10000.0).alias("renovation"),
        F.lit(2500.0).alias("legal"), F.lit(300.0).alias("other_monthly"))


BUYERS_SQL = """buyers AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS DECIMAL(18,2)) AS price, CAST(floor(o_totalprice * 0.95::DOUBLE) AS DECIMAL(18,2)) AS value,
  CASE o_custkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'hdb' ELSE 'none' END AS loan_type, 20 + o_custkey % 10 AS years, (o_custkey % 2 * 20) AS absd,
  least(CAST(floor(greatest(c_acctbal, 0)) * 10 AS DECIMAL(18,2)), 60000) AS cpf_cap FROM orders JOIN customer ON c_custkey = o_custkey),
b1 AS (SELECT *, least(price, value) AS base, CASE WHEN loan_type = 'bank' AND years > 25 THEN 0.55 ELSE 0.75 END AS ltv FROM buyers),
b2 AS (SELECT *, CASE WHEN loan_type = 'none' THEN 0 ELSE round(base * ltv, 2) END AS loan,
  CASE WHEN loan_type = 'bank' THEN round(base * CASE WHEN ltv <= 0.55 THEN 0.10 ELSE 0.05 END, 2) ELSE 0 END AS bank_cash FROM b1),
b3 AS (SELECT *, least(cpf_cap, greatest(0, base - loan - bank_cash)) AS cpf FROM b2),
b4 AS (SELECT *, price - loan - cpf AS cash_price, """ + sql_duty("greatest(price, value)") + """ AS duty, floor(greatest(price, value) * absd / 100) AS extra,
  CASE WHEN loan > 0 THEN round(loan::DOUBLE * (0.03::DOUBLE/12) / (1 - power(1 + 0.03::DOUBLE/12, -(years*12)::DOUBLE)), 2) ELSE 0 END AS payment FROM b3),
b5 AS (SELECT *, round((cash_price::DOUBLE + duty + extra::DOUBLE + 12500), 2) AS cash FROM b4)"""


@query("k3_buyer_scenarios", f"""WITH {BUYERS_SQL}
SELECT o_orderkey, loan::DOUBLE AS loan_used, cpf::DOUBLE AS cpf_used, cash_price::DOUBLE AS cash_for_price, duty AS stamp_duty, extra::DOUBLE AS additional_duty, cash AS initial_cash,
 round(payment + 300, 2) AS monthly_outflow, greatest(0, round(cash - 100000, 2)) AS cash_shortfall, CASE WHEN loan > 0 THEN payment <= 2700 END AS ratio_30_pass,
 payment + 300 <= 1500 AS within_budget, round(cash + cpf::DOUBLE + (payment + 300) * 60, 2) AS five_year_outflow FROM b5""")
def _k3(spark, sf):
    x = N.buyer_scenarios(buyers(spark, sf), "asking_price", "official_value")
    names = ["loan_used", "cpf_used", "cash_for_price", "stamp_duty", "additional_duty", "initial_cash", "monthly_outflow", "cash_shortfall", "five_year_outflow"]
    return x.select("o_orderkey", *[F.col(n).cast("double").alias(n) for n in names], "ratio_30_pass", "within_budget")


@query("k4_affordability_ceiling", """
WITH RECURSIVE b AS (SELECT c_custkey, (20000 + floor(greatest(c_acctbal, 0)) * 10)::DOUBLE AS cash, (800 + c_custkey % 2000)::DOUBLE AS budget FROM customer),
s AS (SELECT c_custkey, cash, budget, 0::BIGINT AS lo, 10000000::BIGINT AS hi, 0 AS i FROM b
 UNION ALL SELECT c_custkey, cash, budget, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m - 1 END, i + 1 FROM (
   SELECT *, (m - loan)::DOUBLE + duty + 2500 <= cash AND round(loan::DOUBLE * (0.026::DOUBLE/12) / (1 - power(1 + 0.026::DOUBLE/12, -300.0::DOUBLE)), 2) <= budget AS ok FROM (
     SELECT *, round(m * 0.75, 2) AS loan, """ + sql_duty("m") + """ AS duty FROM (SELECT *, (lo + hi + 1) // 2 AS m FROM s WHERE lo < hi AND i < 24))))
SELECT c_custkey, max(lo) FILTER (lo = hi) AS ceiling_price FROM s GROUP BY 1""")
def _k4(spark, sf):
    c = table(spark, sf, "customer")
    b = c.select("c_custkey", F.lit("hdb").alias("loan_type"), F.lit(25).alias("loan_years"), F.lit(2.6).alias("annual_rate_pct"), F.lit(2500.0).alias("legal"),
                 (F.lit(20000.0) + F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))) * 10).alias("cash_available"),
                 (F.lit(800) + F.col("c_custkey") % 2000).cast("double").alias("monthly_budget"))
    return N.affordability_ceiling(b).select("c_custkey", "ceiling_price")


@query("k5_one_factor_sensitivity", f"""WITH {BUYERS_SQL},
c AS (SELECT o_orderkey, 'interest_rate_minus_1pp' AS "case", loan, years AS y, 0.02::DOUBLE AS r, cash FROM b5 WHERE loan_type <> 'none'
 UNION ALL SELECT o_orderkey, 'interest_rate_plus_1pp', loan, years, 0.04::DOUBLE, cash FROM b5 WHERE loan_type <> 'none'
 UNION ALL SELECT o_orderkey, 'loan_term_minus_5y', loan, years - 5, 0.03::DOUBLE, cash FROM b5 WHERE loan_type <> 'none' AND NOT (loan_type = 'bank' AND years > 25 AND years - 5 <= 25)
 UNION ALL SELECT o_orderkey, 'loan_term_plus_5y', loan, years + 5, 0.03::DOUBLE, cash FROM b5 WHERE loan_type <> 'none' AND years + 5 <= CASE WHEN loan_type = 'hdb' THEN 25 ELSE 30 END AND NOT (loan_type = 'bank' AND years <= 25)
 UNION ALL SELECT o_orderkey, 'renovation_plus_10000', loan, years, 0.03::DOUBLE, cash + 10000 FROM b5 UNION ALL SELECT o_orderkey, 'renovation_minus_10000', loan, years, 0.03::DOUBLE, cash - 10000 FROM b5)
SELECT o_orderkey, "case", round(cash, 2) AS initial_cash, CASE WHEN loan > 0 THEN round(round(loan::DOUBLE * (r/12) / (1 - power(1 + r/12, -(y*12)::DOUBLE)), 2) + 300, 2) ELSE 300 END AS monthly_outflow FROM c""")
def _k5(spark, sf):
    x = N.sensitivity(buyers(spark, sf), "asking_price", "official_value")
    return x.select("o_orderkey", "case", F.col("initial_cash").cast("double").alias("initial_cash"), F.col("monthly_outflow").cast("double").alias("monthly_outflow"))


@query("k6_proceeds_waterfall", """
WITH s AS (SELECT o_orderkey, n AS scenario, round(CAST(o_totalprice AS DECIMAL(18,2)) * f, 2) AS price, CAST(o_custkey % 300 * 1000 AS DECIMAL(18,2)) AS loan, CAST(o_custkey % 70 * 1000 AS DECIMAL(18,2)) AS refund
  FROM orders, (VALUES ('conservative', 0.95), ('expected', 1.00), ('optimistic', 1.05)) v(n, f)),
a AS (SELECT *, least(price, loan) AS paid FROM s), b AS (SELECT *, least(price - paid, refund) AS refunded FROM a), c AS (SELECT *, least(price - paid - refunded, 14000) AS fees FROM b)
SELECT o_orderkey, scenario, price::DOUBLE AS sale_price, paid::DOUBLE AS loan_paid, (loan - paid)::DOUBLE AS loan_top_up, refunded::DOUBLE AS refund_paid, (refund - refunded)::DOUBLE AS refund_shortfall,
  (14000 - fees)::DOUBLE AS fees_top_up, (price - paid - refunded - fees)::DOUBLE AS cash_proceeds, (price - paid - refunded - fees - 50000)::DOUBLE AS cash_gap_to_next_home FROM c""")
def _k6(spark, sf):
    k = F.col("o_custkey")
    s = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("expected_price"), (k % 300 * 1000).cast("double").alias("loan"), (k % 70 * 1000).cast("double").alias("refund"),
        F.lit(14000.0).alias("fees"), F.lit(50000.0).alias("next_home_cash"), F.lit(10000.0).alias("next_home_cpf"))
    names = ["sale_price", "loan_paid", "loan_top_up", "refund_paid", "refund_shortfall", "fees_top_up", "cash_proceeds", "cash_gap_to_next_home"]
    return N.proceeds(s).select("o_orderkey", "scenario", *[F.col(n).cast("double").alias(n) for n in names])


@query("k7_input_validation", """
SELECT problems, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c_custkey % 5 = 4 THEN 'loan_type' END, CASE WHEN c_acctbal <= 0 THEN 'price_or_value_not_positive' END,
  CASE WHEN c_custkey % 5 IN (0, 1) AND NOT (10 + c_custkey % 25 BETWEEN 1 AND CASE WHEN c_custkey % 5 = 0 THEN 25 ELSE 30 END) THEN 'loan_years'
       WHEN c_custkey % 5 = 4 AND NOT (10 + c_custkey % 25 BETWEEN 1 AND 30) THEN 'loan_years' END,
  CASE WHEN c_custkey % 5 NOT IN (1) AND c_custkey % 4 = 0 THEN 'bank_cash_without_bank_loan' END, CASE WHEN c_custkey % 5 = 1 AND c_custkey % 4 = 0 THEN 'bank_cash_too_low' END,
  CASE WHEN c_custkey % 6000 > 5000 THEN 'deposit_above_limit' END) AS problems FROM customer) GROUP BY 1""")
def _k7(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        F.when(k % 5 == 0, "hdb").when(k % 5 == 1, "bank").when(k % 5 == 4, "gift").otherwise("none").alias("loan_type"), F.lit("assumed").alias("value_status"),
        F.col("c_acctbal").alias("asking_price"), F.lit(1.0).alias("official_value"), F.lit(0.0).alias("absd_pct"), F.lit(2.6).alias("annual_rate_pct"),
        (F.lit(10) + k % 25).alias("loan_years"), F.lit(None).cast("double").alias("ltv_limit_pct"), F.when(k % 4 == 0, 1.0).alias("bank_minimum_cash_pct"),
        F.lit(None).cast("double").alias("loan_amount"), (k % 6000).cast("double").alias("option_deposit"),
        F.lit(None).cast("double").alias("fair_value_lower"), F.lit(None).cast("double").alias("fair_value_upper"))
    return c.groupBy(F.array_join(N.buyer_problems(), ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("k8_range_position", "SELECT CASE WHEN o_totalprice < 100000 THEN 'below' WHEN o_totalprice > 300000 THEN 'above' ELSE 'within' END AS position, count(*) AS n FROM orders GROUP BY 1")
def _k8(spark, sf):
    return table(spark, sf, "orders").groupBy(N.range_position(F.col("o_totalprice"), F.lit(100000), F.lit(300000)).alias("position")).agg(F.count(F.lit(1)).alias("n"))
