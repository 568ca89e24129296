"""Literal fixtures per operator, and optimised against naive forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthframe.functions import measures as M
from hearthframe.functions import text as T
from hearthframe.operators import calibration as CAL
from hearthframe.operators import comparables as C
from hearthframe.operators import finance as N
from hearthframe.operators import market as MK
from hearthframe.operators import ordered as O
from hearthframe.operators import quality as Q
from hearthframe.operators import snapshots as SN
from hearthframe.sources import readers as R
from hearthframe.streaming import pages as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sale(i, month_no, price, lease=2003, block="B1", area=90.0, storey=8.0, town="T", kind="4 ROOM", model="M", lat=1.3, lon=103.8):
    return (f"S{i}", month_no, price, town, kind, model, block, area, storey, lease, lat, lon)


SALE = ("transaction_id string, month_no int, resale_price double, town string, flat_type string, flat_model string, block_id string, "
        "floor_area_sqm double, storey_midpoint double, lease_commence_year int, latitude double, longitude double")


def test_weighted_and_plain_median(spark):
    oct24 = 2024 * 12 + 10
    history = spark.createDataFrame([sale(1, 2024 * 12 + 1, 500000.0), sale(2, 2024 * 12 + 9, 600000.0), sale(3, oct24, 9.0)], SALE)
    target = spark.createDataFrame([sale(9, oct24, 0.0)], SALE)
    row = C.estimate_targets(target, history).first()
    assert (row["comparable_tier"], row["comparable_count"]) == ("town_flat_type_fallback", 2)
    assert (row["median_price"], row["weighted_price"]) == (550000.0, 600000.0)


def test_lease_cohorts_and_relaxation(spark):
    m = 2024 * 12 + 6
    rows = [sale(i, m - 1 - i % 6, 400000.0 + i, lease=2003 if i < 6 else 2017, block=f"B{i % 3 + 5}") for i in range(12)]
    history = spark.createDataFrame(rows, SALE)
    targets = spark.createDataFrame([sale(90, m, 0.0, lease=2003), sale(91, m, 0.0, lease=1980), sale(92, m, 0.0, lease=None)], SALE)
    got = {r["lease_commence_year"]: r for r in C.estimate_targets(targets, history).collect()}
    assert (got[2003]["comparable_count"], got[2003]["comparable_tier"]) == (6, "nearby_similar_24m_similar_lease")
    assert (got[1980]["comparable_count"], got[1980]["comparable_tier"]) == (12, "nearby_similar_24m_lease_relaxed")
    assert got[None]["comparable_tier"].endswith("lease_relaxed")


def test_general_and_bounded_estimates_agree(spark):
    rng = random.Random(5)
    pairs = [(f"p{rng.randint(0, 5)}", 100, 100 - rng.randint(1, 24), float(rng.randint(1, 40) * 1000), rng.randint(1, 3)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "profile_id string, month_no int, h_month_no int, h_price double, sales long")
    a = {tuple(r) for r in C._estimate(df, ["profile_id"]).collect()}
    b = {tuple(r) for r in C._estimate_small(df, ["profile_id"]).collect()}
    assert a == b and len(a) == 6


def test_quantiles_match_sorted_lists(spark):
    rng = random.Random(1)
    rows = [(k, round(rng.lognormvariate(3, 2) * rng.choice([-1, 1]), 2)) for k in ("a", "b", None) for _ in range(rng.randint(3, 90))]
    got = {r["k"]: r for r in O.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.3}, count_as="n").collect()}
    fin = {r["k"]: r["q"] for r in O.finite_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.9}).collect()}
    for key in ("a", "b", None):
        values = sorted(v for k, v in rows if k == key)
        at = (len(values) - 1) * 0.3
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        assert got[key]["q"] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))
        assert got[key]["n"] == len(values)
        assert fin[key] == values[min(len(values), max(1, math.ceil((len(values) + 1) * 0.9))) - 1]


def test_identical_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(Q, "COPIES_PER_CHUNK", 3)
    df = spark.createDataFrame([("x",)] * 10 + [("y",)], "v string")
    got = sorted((r["v"], r["occurrence"]) for r in Q.number_identical_rows(df).collect())
    assert got == [("x", i) for i in range(1, 11)] + [("y", 1)]


def test_scenario_range_ladder(spark):
    offsets = {"95": (-50.0, 50.0), "97.5": (-80.0, 80.0), "local": (-120.0, 120.0)}

    def run(n, local):
        b = one(spark, MK.scenario_range(F.lit(500.0), F.lit(n), F.lit(local), offsets))
        return b["lower"], b["upper"], b["limited"]
    assert run(20, 99) == (380.0, 620.0, True)
    assert run(20, 100) == (450.0, 550.0, False)
    assert run(4, 100) == (420.0, 580.0, False)


@pytest.mark.parametrize("price,duty", [(180000, 1800), (360000, 5400), (1000000, 24600), (0, 0), (50, 1)])
def test_stamp_duty(spark, price, duty):
    assert float(one(spark, N.stamp_duty(N.money(price)))) == duty


def test_sale_proceeds(spark):
    df = spark.createDataFrame([(600000.0, 200000.0, 150000.0, 14000.0)], "expected_price double, loan double, refund double, fees double")
    r = {x["scenario"]: x for x in N.proceeds(df).collect()}
    assert float(r["expected"]["cash_proceeds"]) == 236000 and float(r["expected"]["refund_paid"]) == 150000
    assert float(r["conservative"]["sale_price"]) == 570000 and float(r["optimistic"]["sale_price"]) == 630000
    for x in r.values():
        assert x["sale_price"] == x["loan_paid"] + x["refund_paid"] + x["fees_paid"] + x["cash_proceeds"]


def test_ceiling_is_the_last_price_that_fits(spark):
    df = spark.createDataFrame([("hdb", 25, 2.6, 100000.0, 80000.0, 2400.0)],
                               "loan_type string, loan_years int, annual_rate_pct double, cash_available double, cpf_available double, monthly_budget double")
    top = N.affordability_ceiling(df).first()["ceiling_price"]
    asked = df.withColumn("price", F.explode(F.array(F.lit(float(top)), F.lit(float(top + 1)))))
    fits = [r["within_cash"] and r["within_budget"] for r in N.buyer_scenarios(asked, "price", "price").orderBy("price").collect()]
    assert fits == [True, False]


def test_address_words_and_prefix(spark):
    assert one(spark, T.expand_address_words(F.lit("Upp. Bt Timah rd"))) == "UPPER BUKIT TIMAH ROAD"
    assert one(spark, T.geocode_text(F.lit("bt timah rd"))) == "BT TIMAH ROAD"
    assert one(spark, T.strip_block_prefix(F.lit(" blk. # 12a"))) == "12A"


def test_lease_and_storey(spark):
    assert one(spark, M.lease_months(F.lit("61 years 04 months"))) == 736
    assert one(spark, M.lease_months(F.lit("61 years 12 months"))) is None
    assert one(spark, M.storey_midpoint(F.lit("07 TO 09"))) == 8.0
    assert one(spark, M.storey_midpoint(F.lit("09 TO 07"))) is None


def test_html_pairs_last_key_wins(spark):
    html = "<table><tr><th>A</th><td>1 &amp; 2</td></tr><tr><TH x='y'>B</TH> <td><b>3</b></td></tr><tr><th>A</th><td>9</td></tr></table>"
    assert one(spark, T.html_pairs(F.lit(html))) == {"A": "9", "B": "3"}


def test_card_fields(spark):
    text = "7\nS$ 550,000\n12 Elm St\nElm St, District 1\n3\n2\n1,001 sqft\n4 ROOM\nBuilt: 1999"
    c = one(spark, T.parse_card(F.lit("12 Elm St"), F.lit(text)))
    assert (c["title"], c["asking_price_sgd"], c["address"], c["block"], c["street"]) == ("", 550000, "12 Elm St", "12", "ELM ST")
    assert (c["bedrooms"], c["bathrooms"], c["floor_area_sqft"], c["floor_area_sqm"], c["property_type"]) == ("3", "2", 1001, 93.0, "4 ROOM")


def test_snapshot_skip_is_new_again(spark):
    rows = [("s", "r1", 1, 1, 10.0), ("s", "r2", 2, 2, 5.0), ("s", "r3", 1, 3, 10.0), ("s", "r3", 2, 3, 4.0)]
    df = spark.createDataFrame(rows, "source_site string, run_id string, listing_id long, last_seen int, asking_price_sgd double")
    got = {(r["run_id"], r["listing_id"]): r["change_type"] for r in SN.snapshot_changes(df).collect()}
    assert got == {("r1", 1): "new", ("r2", 2): "new", ("r3", 1): "new", ("r3", 2): "price_reduced"}
    gone = {r["run_id"]: r["disappeared_from_previous_count"] for r in SN.snapshot_summary(df).collect()}
    assert gone == {"r1": 0, "r2": 1, "r3": 0}


def test_redelivered_batch_changes_nothing(spark):
    rows = [("s", "r", 1, 7, 5.0, 2), ("s", "r", 1, 8, 6.0, 3), ("s", "r", 2, 9, 1.0, 2)]
    df = spark.createDataFrame(rows, "source_site string, run_id string, listing_id long, event_id long, asking_price_sgd double, page_number int") \
        .withColumn("observed_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.col("event_id").cast("decimal(8,6)")))
    log = P.StreamTable(spark, "unit-log", P.LISTING_STATE)
    log.write(P.batch_rows(df), 0)
    first = sorted(map(repr, P.merge_rows(log.read().drop("batch")).collect()))
    log.write(P.batch_rows(df), 0)
    log.write(P.batch_rows(df), 1)
    assert sorted(map(repr, P.merge_rows(log.read().drop("batch")).collect())) == first


def test_audit_is_idempotent(spark):
    row = [("main", "5", "https://a.example.org/x-5", "42", "Blk 12 Elm St", "Elm St", "", "", 1, 900, '{"heading":"Blk 12 Elm St"}')]
    schema = ("source_site string, listing_id string, listing_url string, title string, project_name string, address string, block string, street string, "
              "asking_price_sgd int, floor_area_sqft int, raw_card_json string")
    a = Q.audit_listings(spark.createDataFrame(row, schema), "main", ["a.example.org"])
    assert set(a.first()["changes"]) == {"title", "address", "block", "street", "project_name"}
    again = Q.audit_listings(Q.apply_changes(a), "main", ["a.example.org"])
    assert again.first()["changes"] == {} and again.first()["issues"] == []


def test_missing_csv_column_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿a,b\n1,2\n")
    assert R.scan_csv(spark, str(tmp_path), ["a"]).first()["a"] == "1"
    with pytest.raises(ValueError, match="missing columns: z"):
        R.scan_csv(spark, str(tmp_path), ["a", "z"])


def test_release_gate_needs_both_splits(spark):
    rows = [("validation", 10.0, 20.0, 12.0), ("test", 10.0, 20.0, 25.0)]
    df = spark.createDataFrame(rows, "dataset_split string, actual_price double, old_price double, new_price double")
    assert CAL.release_gate(df, "M", "B").first()["released_model"] == "B"
    assert CAL.release_gate(df.filter("dataset_split = 'validation'").unionByName(
        df.filter("dataset_split = 'test'").withColumn("new_price", F.lit(11.0))), "M", "B").first()["released_model"] == "M"


def test_gates_raise(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test")], "id string, dataset_split string")
    with pytest.raises(Q.GateError):
        Q.enforce(Q.gate_report(df, df, "id", [], "dataset_split", ["train", "test"]))


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    from hearthframe import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_csv_keeps_doubled_quotes_and_line_breaks(spark, tmp_path):
    from hearthframe.sources.readers import scan_csv
    from hearthframe.sources.sinks import report_files
    (tmp_path / "a.csv").write_text('k,v\n1,"x ""q"" y, z"\n2,"two\nlines"\n')
    rows = {r.k: r.v for r in scan_csv(spark, str(tmp_path / "a.csv"), ["k"], line_breaks=True).collect()}
    assert rows == {"1": 'x "q" y, z', "2": "two\nlines"}
    path, _ = report_files(spark.createDataFrame([(1, 'say "hi", \\ ok')], "k int, v string"), str(tmp_path / "out"))
    assert scan_csv(spark, path, ["k"]).first().v == 'say "hi", \\ ok'


def test_update_from_sets_null(spark):
    from hearthframe.sources.sinks import update_from
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = update_from(target, spark.createDataFrame([(1, None)], "k int, v string"), ["k"], ["v"])
    assert {r.k: r.v for r in got.collect()} == {1: None, 2: "b"}


def test_wide_radius_and_blocks_without_a_point(spark):
    from hearthframe.functions.measures import haversine_m
    from hearthframe.operators.spatial import nearest_and_within
    blocks = spark.createDataFrame([("B1", 60.0, 25.0), ("B2", None, None)], "block_id string, latitude double, longitude double")
    spots = spark.createDataFrame([("S", 60.0 + 0.02 * k, 25.0 + 0.05 * k) for k in range(1, 9)], "category string, latitude double, longitude double")
    for radius in (1000.0, 5000.0, 12000.0):
        want = spots.where(haversine_m(F.lit(60.0), F.lit(25.0), F.col("latitude"), F.col("longitude")) <= radius).count()
        got = {r.block_id: (r.nearest_m, r.within_radius) for r in nearest_and_within(blocks, spots, radius).collect()}
        assert got["B1"][1] == want and got["B2"] == (None, 0)


def test_median_with_nan_last(spark):
    from hearthframe.operators.ordered import quantiles
    values = spark.createDataFrame([(x,) for x in (-5.0, 100.0, 200.0, float("nan"))], "x double")
    assert quantiles(values, [], "x", {"m": 0.5}).first().m == 150.0


def test_bootstrap_ignores_partitioning(spark):
    from hearthframe.operators.models import paired_bootstrap
    pairs = spark.range(400).selectExpr("cast(id as string) AS transaction_id", "100.0 AS actual_price", "100.0 + id % 7 AS old_price", "100.0 + id % 5 AS new_price")
    one, many = (paired_bootstrap(pairs.repartition(n), 300).first() for n in (1, 9))
    assert abs(one.low - many.low) < 1e-9 and abs(one.high - many.high) < 1e-9 and one.low < one.mae_difference < one.high


def test_every_request_gives_one_row_with_status_and_reason(spark):
    from hearthframe.operators import valuation as V
    from hearthframe.plans import market as PM
    sf = "/root/testdata/sf0.001"
    odd = [(9001, "no such block", "SMALL", 20.0, 5.0), (9002, "B1", "no such type", 20.0, 5.0)]
    asked = PM.requests(spark, sf)
    asked = asked.unionByName(spark.createDataFrame(odd, asked.schema))
    n = asked.count()
    for value in (V.value_requests, V.value_partial_requests):
        rows = value(asked, PM.blocks(spark, sf), PM.sales(spark, sf), PM.local_counts(spark, sf), PM.VALUATION_MONTH).collect()
        got = {str(r.request_id): r for r in rows}
        assert len(rows) == len(got) == n
        assert got["9001"].valuation_note == "unknown_block" and got["9001"].lower_estimate is None
        assert all((r.price_estimate is None) == (r.valuation_status == "not_valued") == (r.valuation_note is not None) for r in rows)
        assert any(r.valuation_status == "estimated" for r in rows)


def test_partial_requests_keep_null_and_repeated_ids(spark):
    from hearthframe.operators import valuation as V
    from hearthframe.plans import market as PM
    from hearthframe.sources.tables import blocks, sales
    sf = "/root/testdata/sf0.001"
    asked = spark.createDataFrame([(None, "B1", None, None, None), (None, "B2", None, 10.0, None), (7, "B1", None, None, 5.0), (7, "B1", None, None, 5.0), (7, "B3", None, 20.0, 5.0)],
                                  "request_id long, block_id string, flat_type string, floor_area_sqm double, storey_midpoint double")
    got = [tuple(r) for r in V.value_partial_requests(asked, blocks(spark, sf), sales(spark, sf), PM.local_counts(spark, sf), PM.VALUATION_MONTH).collect()]
    assert sorted(map(str, (r[0] for r in got))) == ["7", "7", "7", "None", "None"]
    assert len(set(got)) == 4 and sum(got.count(r) == 2 for r in set(got)) == 1


def test_scenarios_carry_their_closest_sales(spark):
    from hearthframe.operators import valuation as V
    from hearthframe.plans import market as PM
    from hearthframe.sources.tables import blocks, sales
    sf = "/root/testdata/sf0.001"
    base = sales(spark, sf)
    rows = V.value_listings(PM.listing_features(spark, sf), blocks(spark, sf), base, PM.local_counts(spark, sf), PM.VALUATION_MONTH).filter(
        "valuation_status = 'estimated'").select("block_id", "scenarios").collect()
    sold = {r.transaction_id: r for r in base.collect()}
    assert rows
    for r in rows:
        for s in r.scenarios:
            assert 1 <= len(s.comparables) <= 5 and len(s.comparables) == min(5, s.comparable_count)
            assert [c.comparable_rank for c in s.comparables] == list(range(1, len(s.comparables) + 1))
            for c in s.comparables:
                sale = sold[c.transaction_id]
                assert (c.sale_price_sgd, c.block_id, c.floor_area_sqm) == (sale.resale_price, sale.block_id, sale.floor_area_sqm) and sale.month_no < PM.VALUATION_MONTH
