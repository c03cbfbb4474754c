"""Physical plans: no product joins, no Python where expressions do, only the needed columns."""

from __future__ import annotations

import re

import pytest

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, _ = catalog.load()
PYTHON = {n for n in QUERIES if n.startswith(("image_", "stream_"))}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_no_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("Python|Pandas|Arrow", text)
    if name != "deep_sample_offsets_whole":  # one row per 4096 lines of a single image
        assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n(?:[^\n]*Shuffle[^\n]*\n)?[^\n]*Exchange SinglePartition", text)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("deep_statistics", {"o_orderkey", "l_orderkey"}), ("tonemap_srgb8_histogram", {"value"}), ("layers_distinct", {"p_partkey", "p_name"}), ("rle_runs", {"event_id", "user_id"})],
)
def test_scans_read_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF)))
    assert {c.split(":")[0] for s in read for c in s.split(",") if c} == columns

