"""Queries on copies of the smallest tables where one key holds a third of the rows."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.operators import scope
from codeloom.plans import projection
from tests.compare import compare, duck

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "select case when (l_partkey + l_suppkey + l_linenumber) % 3 = 0 then 1 else l_orderkey end as l_orderkey, * exclude (l_orderkey) from '{s}'",
    "orders": "select o_orderkey, case when o_orderkey % 3 = 0 then 5 else o_custkey end as o_custkey, * exclude (o_orderkey, o_custkey) from '{s}'",
    "events": "select event_id, ts, case when event_id % 3 = 0 then 3 else user_id end as user_id, * exclude (event_id, ts, user_id) from '{s}'",
    "conversations": """select case when rn % 3 = 0 then 0 else conv_id end as conv_id, case when rn % 3 = 0 then 1000 + rn else turn end as turn, role, text
        from (select *, row_number() over (order by conv_id, turn) as rn from '{s}')""",
}
NAMES = (
    "sibling_sample", "resolve_internal", "encode_evidence", "slot_packing", "tree_paths", "struct_counts", "reject_counts",
    "best_of_beam", "bleu_averages", "position_accuracy", "beam_topk", "hasnext_guard", "package_label",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for file in os.listdir(SOURCE):
        name = file[: -len(".parquet")]
        if name in HOT:
            con.execute(f"copy ({HOT[name].format(s=f'{SOURCE}/{file}')}) to '{folder}/{file}' (format parquet)")
        else:
            shutil.copy(f"{SOURCE}/{file}", f"{folder}/{file}")
    return folder


PARTS = ("tree_flatten", "iterator_attributes", "declared_types", "visible_declarations", "static_outcome", "lower_programs")


@pytest.mark.parametrize("name", PARTS)
def test_a_hot_program_in_parts(spark, skewed, name, monkeypatch):
    """One order holds a third of all lines; it is flattened in parts and scanned in bins, all far smaller than it."""
    monkeypatch.setattr(projection, "PART_LINES", 100)
    monkeypatch.setattr(scope, "BIN", 64)
    rows, problem = compare(spark, duck(skewed), entry.queries()[name], entry.oracle_sql()[name], skewed)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    rows, problem = compare(spark, duck(skewed), entry.queries()[name], entry.oracle_sql()[name], skewed)
    assert problem is None and rows > 0
