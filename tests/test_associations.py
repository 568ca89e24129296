"""Associations of many columns in one pass against those of one column at a time."""

import random

import pytest

from hearthframe.operators import stats as S


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(1), []
    for i in range(400):
        y = rng.gauss(10, 3)
        out.append((y if i % 31 else None, round(y + rng.gauss(0, 2), 1) if i % 17 else None, float(rng.randint(0, 4)), 5.0, float("nan") if i % 9 == 0 else -y * y,
                    rng.choice(["a", "b", None]), rng.choice("xyz")))
    return spark.createDataFrame(out, "y double, near double, few double, flat double, bent double, kind string, g string").repartition(4)


def test_equal_one_column_at_a_time(spark, rows):
    names = ["near", "few", "flat", "bent"]
    got = {r.column: r for r in S.numeric_associations(rows, names, "y", "kind").collect()}
    for name in names:
        one = (S.pearson(rows, name, "y").first()["pearson_r"], S.spearman(rows, name, "y").first()["spearman_rho"],
               S.within_group_pearson(rows, name, "y", "kind").first()["within_r"])
        for a, b in zip(one, (got[name].pearson_r, got[name].spearman_rho, got[name].within_r)):
            assert (a is None and b is None) or abs(a - b) < 1e-9, (name, a, b)
    eta = {r.column: r.eta_squared for r in S.category_associations(rows, ["kind", "g"], "y").collect()}
    assert all(abs(eta[c] - S.eta_squared(rows, c, "y").first()["eta_squared"]) < 1e-9 for c in ("kind", "g"))
    assert S.numeric_associations(rows, [], "y", "g").collect() == [] and S.category_associations(rows, [], "y").collect() == []


def test_reads_do_not_grow_with_columns(spark, rows, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    wide = rows.select("*", *[(F.col("few") * k).alias(f"c{k}") for k in range(40)])
    wide.write.parquet(str(tmp_path / "wide"))
    wide, scans, real = spark.read.parquet(str(tmp_path / "wide")), [], S.materialise
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    def counting(df, name):
        scans[-1] += count(df)
        return real(df, name)
    monkeypatch.setattr(S, "materialise", counting)
    for n in (3, 40):
        scans.append(0)
        out = S.association_profile(wide, [f"c{k}" for k in range(n)], ["kind", "g"], ["near"], "y", "g")
        scans[-1] += count(out)
        assert out.count() == n + 3
    assert scans[0] == scans[1]
