"""Scalar-expression queries (survey group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.functions import measures as M
from hearthframe.functions import text as T
from hearthframe.plans.registry import query
from hearthframe.session import spread
from hearthframe.sources.tables import (
    BLOCKS_SQL, SALES_SQL, SPLIT_SQL, blocks, facilities, FACILITIES_SQL, sales, table, with_split)


def _sql_map(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"


def _sql_expand(expr: str, words: dict[str, str]) -> str:
    return (f"array_to_string(list_transform(string_split_regex(trim(regexp_replace(upper({expr}), "
            f"'[^A-Z0-9]+', ' ', 'g')), ' +'), lambda x: coalesce({_sql_map(words)}[x], x)), ' ')")


@query("b1_normalise_ws_upper", """
SELECT c_custkey, upper(regexp_replace(trim('  ' || c_name || '   of ' || c_mktsegment), '\\s+', ' ', 'g')) AS normalised,
       upper(c_name) || '|' || upper(c_mktsegment) AS block_key FROM customer""")
def _b1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", T.normalise(F.concat(F.lit("  "), "c_name", F.lit("   of "), "c_mktsegment")).alias("normalised"),
                    T.block_key(F.col("c_name"), F.col("c_mktsegment")).alias("block_key"))


_WORDY = "concat('Upp. ', p_name, ' ave/St ', p_type, ' Rd')"


@query("b2_normalise_address_tokens", f"SELECT p_partkey, {_sql_expand(_WORDY, K.STREET_WORDS)} AS address FROM part")
def _b2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.expand_address_words(F.expr(_WORDY)).alias("address"))


@query("b3_normalise_address_infix", f"SELECT p_partkey, {_sql_expand(_WORDY, K.GEOCODE_WORDS)} AS address FROM part")
def _b3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.geocode_text(F.expr(_WORDY)).alias("address"))


@query("b4_strip_block_prefix", """
SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || 'A' AS stripped, 'BLOCK PARTY' AS kept FROM supplier""")
def _b4(spark, sf):
    s = table(spark, sf, "supplier")
    written = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "blk. #").otherwise("Block "), F.col("s_suppkey"), F.lit("a"))
    return s.select("s_suppkey", T.strip_block_prefix(written).alias("stripped"),
                    T.strip_block_prefix(F.lit("block party")).alias("kept"))


@query("b5_stable_id", """
SELECT c_custkey, 'CUST_' || substr(sha256('["' || c_custkey || '","' || c_name || '"]'), 1, 20) AS stable_id FROM customer""")
def _b5(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", T.stable_id("CUST", F.col("c_custkey"), F.col("c_name")).alias("stable_id"))


@query("b6_occurrence_id", """
SELECT user_id, event_type, occurrence, count(*) AS n_rows FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type) AS occurrence FROM events)
GROUP BY ALL""")
def _b6(spark, sf):
    from hearthframe.operators.quality import number_identical_rows
    e = table(spark, sf, "events").select("user_id", "event_type")
    return number_identical_rows(e).groupBy("user_id", "event_type", "occurrence").agg(F.count(F.lit(1)).alias("n_rows"))


_LEASE = ("CASE WHEN l_partkey % 7 = 0 THEN concat(l_linenumber, ' yrs') WHEN l_partkey % 5 = 0 THEN concat(l_partkey % 99, ' years') "
          "ELSE concat(l_partkey % 99, ' years ', l_suppkey % 14, ' months') END")


@query("b7_parse_lease_months", """
SELECT months, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN (l_partkey % 99) * 12
  WHEN l_suppkey % 14 > 11 THEN NULL ELSE (l_partkey % 99) * 12 + l_suppkey % 14 END AS months FROM lineitem) GROUP BY months""")
def _b7(spark, sf):
    li = table(spark, sf, "lineitem").select(M.lease_months(F.expr(_LEASE)).alias("months"))
    return li.groupBy("months").agg(F.count(F.lit(1)).alias("n"))


@query("b8_parse_storey_midpoint", """
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size + 1.0::DOUBLE END AS midpoint FROM part""")
def _b8(spark, sf):
    text = F.expr("CASE WHEN p_size % 9 = 0 THEN concat(p_size + 2, ' TO ', p_size) ELSE concat(p_size, ' TO ', p_size + 2) END")
    return table(spark, sf, "part").select("p_partkey", M.storey_midpoint(text).alias("midpoint"))


@query("b9_storey_band_from_floor", """
SELECT p_partkey, lpad(CAST(1 + 3*((p_size-1)//3) AS VARCHAR),2,'0') || ' TO ' || lpad(CAST(3 + 3*((p_size-1)//3) AS VARCHAR),2,'0') AS band FROM part""")
def _b9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", M.storey_band(F.col("p_size")).alias("band"))


@query("b10_parse_coordinate", """
SELECT coalesce(CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber = 2 THEN 'invalid'
       WHEN NOT (l_quantity / 30 BETWEEN 1.1 AND 1.6) THEN 'outside_bounds' END, 'ok') AS outcome, count(*) AS n FROM lineitem GROUP BY 1""")
def _b10(spark, sf):
    lat = F.expr("CASE WHEN l_linenumber = 1 THEN ' ' WHEN l_linenumber = 2 THEN 'n/a' ELSE cast(l_quantity / 30 AS string) END")
    reason = M.coordinate_reason(lat, F.lit("103.8"))
    return table(spark, sf, "lineitem").select(F.coalesce(reason, F.lit("ok")).alias("outcome")) \
        .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("b11_coordinate_order_sniff", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE round(1.2 + (s_suppkey % 100) * 0.003, 3)::DOUBLE END AS latitude,
  CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 103.8::DOUBLE END AS longitude,
  CASE s_suppkey % 3 WHEN 0 THEN 'longitude_latitude' WHEN 1 THEN 'latitude_longitude' END AS coordinate_order FROM supplier""")
def _b11(spark, sf):
    lat = "cast(cast(1.2 + (s_suppkey % 100) * 0.003 AS decimal(6,3)) AS string)"
    raw = F.expr(f"CASE s_suppkey % 3 WHEN 0 THEN concat('[7, 8, 103.8, ', {lat}, ']') "
                 f"WHEN 1 THEN concat('9 9 ', {lat}, ',103.8') ELSE concat('POINT ', s_suppkey) END")
    p = M.sniff_coordinate(raw)
    return table(spark, sf, "supplier").select("s_suppkey", p["latitude"].alias("latitude"),
                                               p["longitude"].alias("longitude"), p["order"].alias("coordinate_order"))


_SQL_HAV = ("12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians({b})-radians({a}))/2)*sin((radians({b})-radians({a}))/2)"
            " + cos(radians({a}))*cos(radians({b}))*sin((radians({d})-radians({c}))/2)*sin((radians({d})-radians({c}))/2))))")


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _SQL_HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query("b12_haversine_m", f"""WITH {FACILITIES_SQL}
SELECT facility_id, round({sql_haversine('latitude', 'longitude', '1.3521', '103.8198')}, 3) AS metres FROM facilities""")
def _b12(spark, sf):
    f = facilities(spark, sf)
    return f.select("facility_id", F.round(M.haversine_m(
        F.col("latitude"), F.col("longitude"), F.lit(1.3521), F.lit(103.8198)), 3).alias("metres"))


@query("b13_month_number", "SELECT o_orderkey, year(o_orderdate)*12 + month(o_orderdate) AS month_no FROM orders")
def _b13(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", M.month_number(F.col("o_orderdate")).cast("bigint").alias("month_no"))


@query("b14_calendar_parts", f"""WITH {SALES_SQL}, {BLOCKS_SQL}
SELECT year(transaction_month) AS y, month(transaction_month) AS m, quarter(transaction_month) AS q,
       year(transaction_month) - year_completed AS building_age, count(*) AS n
FROM sales JOIN blocks USING (block_id) GROUP BY ALL""")
def _b14(spark, sf):
    b = blocks(spark, sf).select("block_id", "year_completed")
    s = sales(spark, sf).select("block_id", "transaction_month").join(b, "block_id")
    return s.groupBy(F.year("transaction_month").alias("y"), F.month("transaction_month").alias("m"),
                     F.quarter("transaction_month").alias("q"),
                     (F.year("transaction_month") - F.col("year_completed")).alias("building_age")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("b15_month_diff_abs", """
SELECT o_orderkey, h AS horizon_years, abs(date_diff('month', DATE '1996-01-01', CAST(o_orderdate AS DATE)) - 12*h) AS gap
FROM orders, (VALUES (1),(3),(5)) v(h)""")
def _b15(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("horizon_years"))
    return o.select("o_orderkey", "horizon_years", M.month_gap_to_horizon(
        F.lit("1996-01-01").cast("date"), F.col("o_orderdate"), F.col("horizon_years")).cast("bigint").alias("gap"))


@query("b16_flag_from_yn", "SELECT l_returnflag, bool_and(l_returnflag = 'A') AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _b16(spark, sf):
    raw = F.when(F.col("l_returnflag") == "A", " y ").otherwise("N")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.bool_and(T.yes_flag(raw)).alias("flag"), F.count(F.lit(1)).alias("n"))


@query("b17_engineered_features", f"""WITH {SALES_SQL}, {BLOCKS_SQL}
SELECT transaction_id, round(storey_midpoint / max_floor_lvl, 6) AS relative_storey,
  power(year(transaction_month) - year_completed, 2) AS age_squared, round(ln(1 + balance_m), 6) AS log_nearest_m,
  CAST(balance_m <= 400 AS DOUBLE) AS within_400m, CAST(balance_m <= 800 AS DOUBLE) AS within_800m,
  round(sin(2*pi()*month(transaction_month)/12), 6) + 0.0 AS month_sin, round(cos(2*pi()*month(transaction_month)/12), 6) + 0.0 AS month_cos
FROM sales JOIN (SELECT *, greatest(0, balance) AS balance_m FROM blocks) USING (block_id)""")
def _b17(spark, sf):
    from hearthframe.operators.models import engineered_features
    b = blocks(spark, sf).select("block_id", "max_floor_lvl", "year_completed", F.col("balance").alias("nearest_m"))
    s = sales(spark, sf).select("transaction_id", "block_id", "transaction_month", "storey_midpoint").join(b, "block_id")
    out = engineered_features(s)
    return out.select("transaction_id", F.round("relative_storey", 6).alias("relative_storey"), "age_squared",
                      F.round("log_nearest_m", 6).alias("log_nearest_m"), "within_400m", "within_800m",
                      (F.round("month_sin", 6) + 0.0).alias("month_sin"), (F.round("month_cos", 6) + 0.0).alias("month_cos"))


@query("b18_category_interactions", f"""WITH {SALES_SQL}
SELECT flat_type, sum(CASE WHEN flat_type='ECONOMY' THEN floor_area_sqm ELSE 0 END) AS area_x_economy,
  sum(CASE WHEN flat_type='SMALL' THEN floor_area_sqm ELSE 0 END) AS area_x_small,
  sum(CASE WHEN flat_type='ECONOMY' THEN CAST(remaining_lease_months AS DOUBLE) ELSE 0 END) AS lease_x_economy,
  sum(CASE WHEN flat_type='SMALL' THEN CAST(remaining_lease_months AS DOUBLE) ELSE 0 END) AS lease_x_small
FROM sales GROUP BY flat_type""")
def _b18(spark, sf):
    from hearthframe.operators.models import interactions
    s = interactions(sales(spark, sf), ["ECONOMY", "SMALL"])
    names = ["area_x_economy", "area_x_small", "lease_x_economy", "lease_x_small"]
    return s.groupBy("flat_type").agg(*[F.sum(n).alias(n) for n in names])


@query("b19_unit_price", f"""WITH {SALES_SQL}
SELECT transaction_id, resale_price / nullif(floor_area_sqm - 1, 0) AS unit_price, remaining_lease_months / 12.0::DOUBLE AS lease_years FROM sales""")
def _b19(spark, sf):
    return sales(spark, sf).select(
        "transaction_id", M.unit_price(F.col("resale_price"), F.col("floor_area_sqm") - 1).alias("unit_price"),
        (F.col("remaining_lease_months") / 12.0).alias("lease_years"))


@query("b20_remaining_lease_months", f"""WITH {SALES_SQL}
SELECT lease_commence_year, CASE WHEN m > 0 AND m <= 1188 THEN m END AS months_left, count(*) AS n
FROM (SELECT lease_commence_year, 1188 - (month_no - (lease_commence_year*12+1)) AS m FROM sales) GROUP BY ALL""")
def _b20(spark, sf):
    s = sales(spark, sf)
    left = M.remaining_lease(F.lit(None).cast("double"), F.col("lease_commence_year"), F.col("transaction_month"))
    return s.groupBy("lease_commence_year", left.alias("months_left")).agg(F.count(F.lit(1)).alias("n"))


SQL_LEASE_BAND = ("CASE WHEN remaining_lease_months < 720 THEN '<60 years' WHEN remaining_lease_months < 840 THEN '60-69 years' "
                  "WHEN remaining_lease_months < 960 THEN '70-79 years' ELSE '80+ years' END")


@query("b21_lease_band", f"WITH {SALES_SQL} SELECT {SQL_LEASE_BAND} AS band, count(*) AS n FROM sales GROUP BY 1")
def _b21(spark, sf):
    return sales(spark, sf).groupBy(M.lease_band(F.col("remaining_lease_months")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_quartile_band", f"""WITH {SPLIT_SQL},
cuts AS (SELECT quantile_cont(resale_price, 0.25) a, quantile_cont(resale_price, 0.5) b, quantile_cont(resale_price, 0.75) c
         FROM split_sales WHERE dataset_split = 'train')
SELECT dataset_split, CASE WHEN resale_price <= a THEN 'Q1' WHEN resale_price <= b THEN 'Q2' WHEN resale_price <= c THEN 'Q3' ELSE 'Q4' END AS band,
       count(*) AS n FROM split_sales, cuts GROUP BY ALL""")
def _b22(spark, sf):
    from hearthframe.operators.stats import training_quartiles
    s = with_split(sales(spark, sf).select("month_no", "resale_price"))
    q1, q2, q3 = training_quartiles(s.filter("dataset_split = 'train'"), "resale_price")
    return s.groupBy("dataset_split", M.quartile_band(F.col("resale_price"), q1, q2, q3).alias("band")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("b23_count_band", """
SELECT CASE WHEN n < 5 THEN '<5' WHEN n < 20 THEN '5-19' ELSE '20+' END AS band, count(*) AS groups
FROM (SELECT l_suppkey, l_partkey % 50 AS g, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _b23(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(M.count_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("groups"))


@query("b24_parse_month", """
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders""")
def _b24(spark, sf):
    text = F.expr("CASE WHEN o_custkey % 10 = 0 THEN date_format(o_orderdate, 'yyyy/MM') ELSE date_format(o_orderdate, 'yyyy-MM') END")
    return table(spark, sf, "orders").select("o_orderkey", M.parse_month(text).alias("month"))


_CODE = "CASE s_suppkey % 4 WHEN 0 THEN 'AMK' WHEN 1 THEN 'TP' WHEN 2 THEN 'YS' ELSE 'ZZ' END"


@query("b25_code_lookup_with_mode_fallback", f"""WITH {SALES_SQL},
modes AS (SELECT block_id, town FROM (SELECT block_id, town, count(*) n, min(month_no) m FROM sales GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY n DESC, m, town) = 1)
SELECT 'B' || s_suppkey AS block_id, coalesce(CASE s_suppkey % 4 WHEN 0 THEN 'ANG MO KIO' WHEN 1 THEN 'TOA PAYOH' WHEN 2 THEN 'YISHUN' END, town) AS town
FROM supplier LEFT JOIN modes ON block_id = 'B' || s_suppkey""")
def _b25(spark, sf):
    from hearthframe.operators.lookups import resolve_town
    b = table(spark, sf, "supplier").select(F.concat(F.lit("B"), "s_suppkey").alias("block_id"), F.expr(_CODE).alias("town_code"))
    return resolve_town(b, sales(spark, sf), "town_code").select("block_id", "town")


_CARD = ("concat('Nice ', p_name, '\\n', 'S$ ', format_number(900000 + p_partkey, 0), '\\n', p_partkey % 999 + 1, ' Main St', '\\n', "
         "'Main St, District 9', '\\n', p_size % 5 + 1, '\\n', p_size % 3 + 1, '\\n', format_number(p_size * 20 + 400, 0), ' sqft', '\\n', "
         "p_type, '\\n', 'Built: ', 1970 + p_size, '\\n', '99-year Leasehold')")


@query("b26_card_text_extract", """
SELECT p_partkey, 'Nice ' || p_name AS title, '' AS project_name, (p_partkey % 999 + 1) || ' Main St' AS address,
  CAST(p_partkey % 999 + 1 AS VARCHAR) AS block, 'MAIN ST' AS street, 900000 + p_partkey AS asking_price_sgd,
  CAST(p_size * 20 + 400 AS BIGINT) AS floor_area_sqft, CAST(p_size % 5 + 1 AS VARCHAR) AS bedrooms,
  CAST(p_size % 3 + 1 AS VARCHAR) AS bathrooms, p_type AS property_type, CAST(1970 + p_size AS VARCHAR) AS built_year, '99-year Leasehold' AS lease
FROM part""")
def _b26(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr("concat(p_partkey % 999 + 1, ' Main St')").alias("heading"), F.expr(_CARD).alias("card"))
    card = spread(p).select("p_partkey", T.parse_card(F.col("heading"), F.col("card")).alias("c"))
    names = ["title", "project_name", "address", "block", "street", "asking_price_sgd", "floor_area_sqft", "bedrooms",
             "bathrooms", "property_type", "built_year", "lease"]
    return card.select("p_partkey", *[f"c.{n}" for n in names])


@query("b27_sqft_to_sqm", "SELECT p_partkey, round(p_size * 100 * 0.09290304::DOUBLE, 2) AS sqm FROM part")
def _b27(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.sqft_to_sqm(F.col("p_size") * 100).alias("sqm"))


_HOSTS = ["thther.example.org", "m.ththth.example.net", "blog.tionsh.example.net"]
_SQL_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_SQL_PATH = "rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')"


@query("b28_url_id_and_canonical", f"""
SELECT page_id, CASE WHEN ok THEN id END AS listing_id, CASE WHEN ok THEN 'https://' || host || path END AS canonical_url FROM (
  SELECT page_id, {_SQL_HOST} AS host, {_SQL_PATH} AS path, regexp_extract({_SQL_PATH}, '(\\d+)$', 1) AS id,
         {_SQL_HOST} IN ('{"','".join(_HOSTS)}') AND regexp_extract({_SQL_PATH}, '(\\d+)$', 1) <> '' AS ok FROM pages)""")
def _b28(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.listing_id_from_url(u, _HOSTS).alias("listing_id"),
                                            T.canonical_url(u, _HOSTS).alias("canonical_url"))


@query("b29_complete_address", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '12 Elm St' WHEN 1 THEN s_suppkey % 900 || ' Elm St' ELSE 'Oak Rd' END AS address,
       s_suppkey % 3 = 1 AS used_heading FROM supplier""")
def _b29(spark, sf):
    address = F.expr("CASE s_suppkey % 3 WHEN 0 THEN '12 Elm St' WHEN 1 THEN 'Elm St' ELSE 'Oak Rd' END")
    done = T.complete_address(address, F.expr("concat('Blk ', s_suppkey % 900, ' elm st North')"))
    # The heading's street starts with the shown address, so only the block number is taken from it.
    return table(spark, sf, "supplier").select("s_suppkey", done["address"].alias("address"), done["used_heading"].alias("used_heading"))


@query("b30_page_url_predicate", f"""
SELECT page_id, coalesce(starts_with(url, 'https://') AND {_SQL_HOST} = 'thther.example.org'
  AND {_SQL_PATH} = CASE WHEN n = 1 THEN '/en' ELSE '/en/' || n END, FALSE) AS matches
FROM (SELECT *, CAST(CASE WHEN page_id % 2 = 0 THEN coalesce(nullif(regexp_extract({_SQL_PATH}, '(\\d+)$', 1), ''), '1') ELSE '1' END AS BIGINT) AS n FROM pages)""")
def _b30(spark, sf):
    p = table(spark, sf, "pages")
    tail = F.regexp_extract(F.rtrim(T.url_part(F.col("url"), "PATH"), F.lit("/")), r"(\d+)$", 1)
    number = F.when(F.col("page_id") % 2 == 0, F.coalesce(F.when(tail != "", tail), F.lit("1"))).otherwise("1").cast("bigint")
    return p.select("page_id", T.page_url_matches(
        F.col("url"), number, "thther.example.org", "/search", "/en", "group", "H").alias("matches"))


_LINK = r'(?s)<a href="/([^"]*)">(.*?)</a>'


@query("b31_html_attribute_map", """
SELECT page_id, len(map_keys(m)) AS n_keys, array_to_string(list_sort(map_keys(m)), '|') AS keys FROM (
  SELECT page_id, map_from_entries(list_distinct(list_transform(
     regexp_extract_all(html, '<a href="/([^"]*)">', 1), lambda x: {k: trim(x), v: 1}))) AS m FROM pages)""")
def _b31(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.map_keys(T.html_pairs(F.col("html"), _LINK)).alias("k"))
    return p.select("page_id", F.size("k").cast("bigint").alias("n_keys"), F.array_join(F.array_sort("k"), "|").alias("keys"))


@query("b32_address_compose", """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey || ' Elm St, #05-' || s_suppkey ELSE 'Elm St' END
  || CASE WHEN s_suppkey % 5 = 0 THEN ', ' || s_name ELSE '' END || ', Singapore ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS address FROM supplier""")
def _b32(spark, sf):
    s = table(spark, sf, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    k = F.col("s_suppkey").cast("string")
    return s.select("s_suppkey", T.compose_address(
        F.when(even, k).otherwise(""), F.lit("Elm St"), F.when(even, "05").otherwise(""), F.when(even, k).otherwise(""),
        F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).otherwise(""), F.lpad(k, 6, "0")).alias("address"))


@query("b33_lenient_utc_parse", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS observed FROM events""")
def _b33(spark, sf):
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN 'not a time' WHEN event_id % 4 = 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
                  "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") END")
    return table(spark, sf, "events").select("event_id", M.parse_utc(text).cast("timestamp_ntz").alias("observed"))


@query("b34_clamp", "SELECT c_custkey, greatest(0.0::DOUBLE, least(100.0::DOUBLE, c_acctbal / 50)) AS score FROM customer")
def _b34(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", M.clamp(F.col("c_acctbal") / 50).alias("score"))


@query("b35_json_path_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def _b35(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("b36_null_safe_label", """
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS quality_label, coalesce(nullif(d.lang, 'en'), 'UNKNOWN') AS lang_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _b36(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("Unknown")).alias("quality_label"),
        F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("UNKNOWN")).alias("lang_label"))


@query("b37_facility_id_rules", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ECDA:' || c_custkey
  WHEN 1 THEN 'ECDA_' || substr(sha256('["' || c_name || '","' || c_mktsegment || '"]'), 1, 20)
  WHEN 2 THEN 'CHAS:' || c_custkey
  ELSE 'POLY_' || substr(sha256('["' || upper(c_name) || '"]'), 1, 20) END AS facility_id FROM customer""")
def _b37(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 4
    category = F.when(kind <= 1, "childcare_centres").when(kind == 2, "healthcare_clinics").otherwise("polyclinics")
    code = F.when(kind == 1, "NA").otherwise(F.col("c_custkey").cast("string"))
    zero = F.lit(0.0)
    return c.select("c_custkey", T.facility_id(category, F.col("c_name"), code, F.col("c_mktsegment"), zero, zero).alias("facility_id"))


@query("b38_date_sub_scalar_subquery", f"""WITH {SALES_SQL}
SELECT transaction_month, count(*) AS n FROM sales WHERE transaction_month >= (SELECT max(transaction_month) - INTERVAL 11 MONTH FROM sales) GROUP BY 1""")
def _b38(spark, sf):
    s = sales(spark, sf).select("transaction_month")
    start = F.add_months(s.agg(F.max("transaction_month").alias("m")).scalar(), -11)
    return s.filter(F.col("transaction_month") >= start).groupBy("transaction_month").agg(F.count(F.lit(1)).alias("n"))
