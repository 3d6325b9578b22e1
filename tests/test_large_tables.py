"""What shows on larger tables only: trades just a day apart, one small file with many scripts, tasks that grow with the rows."""

import datetime

import duckdb

from ledgerlens.plans import catalog, decoded, more, overlays  # noqa: F401


def test_trades_a_day_apart_are_in_two_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    seconds = [(1, 0), (2, 86_400), (3, 172_799), (4, 259_199), (5, None), (6, None)]
    rows = [(i, "view", 1.5, None if s is None else start + datetime.timedelta(seconds=s), buyer) for i, s in seconds for buyer in (7, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = oracle.execute(f"SELECT buyer, start, trades, volume FROM ({catalog.SQL['trade_sessions']})").fetchall()
    got = catalog.QUERIES["trade_sessions"](spark, str(tmp_path)).select("buyer", "start", "trades", "volume").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 10


def test_scripts_of_one_file_are_read_by_many_tasks(spark, small):
    for name in ("token_rows", "token_commits", "contract_states", "token_payees"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("Exchange hashpartitioning(p_partkey"), name


def test_metadata_is_parsed_once(spark, small):
    plan = catalog.QUERIES["token_rows"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_more_outputs_are_more_tasks(spark, small, monkeypatch):
    plain = catalog.QUERIES["contract_lives"](spark, small).orderBy("token").collect()
    monkeypatch.setattr(more, "ROWS_EACH", 500)
    many = catalog.QUERIES["contract_lives"](spark, small)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Expand" not in plan
    assert many.orderBy("token").collect() == plain
