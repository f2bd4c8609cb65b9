from tidemark import catalog


def test_mc_type1_runs_the_nulls_at_the_full_count(spark):
    rows = {r["null"]: r for r in catalog.queries()["mc_type1"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"iid_t3", "garch11", "ar1_0.1", "ar1_0.2", "ar1_0.3", "skewed"}
    assert all(r.n == 20_000 and r.passes / r.n <= r.pass_upper <= 0.05 for r in rows.values())
