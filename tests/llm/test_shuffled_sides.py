"""Every join with a measured side gives the same rows when no side may be broadcast."""

import pytest

from starling.llm import common, queries

SMALL = "/root/testdata/sf0.001"
JOINING = ["op1_warc", "op2_decontaminate", "op3_html", "op5_mixing", "op6_topk", "op9_simhash", "op10_substrings", "op12_token_files"]


@pytest.mark.parametrize("name", JOINING)
def test_rows_do_not_depend_on_broadcasts(spark, name, monkeypatch):
    want = sorted(map(repr, queries.QUERIES[name](spark, SMALL).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, queries.QUERIES[name](spark, SMALL).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
