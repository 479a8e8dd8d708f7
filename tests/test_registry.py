import os

import duckdb
import pytest

from check_oracle import TABLES, compare
from panelyard.registry import load_all

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["flagship_attribution", "W1_cross_z", "W25_pit_buckets", "J4_asof_backward", "F7_evaluate_weights", "H2_rank_ic", "H6_backtest_daily_tranches", "G3_two_hop_mean", "D12_merge_state", "A6_entity_day", "R5_event_paths", "Q15_tidy_contract"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, name):
    q = load_all()[name]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    verdict = compare(q(spark, SMALL).toPandas(), con.execute(q.oracle).df())
    assert verdict in ("ok", "EMPTY"), verdict


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 200
    assert e.entry(spark).columns == ["entity", "factor", "contribution", "periods"]
