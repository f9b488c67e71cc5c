"""Every registered query of the problems on the smallest tables, with the columns it promises."""

import os

import pytest

import __spark_entry__ as entry
from loomwright.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": "id_a string, id_b string",
    "p2_found": "prompt_hash string, model string, defect string",
    "p3_found": "prompt_hash string, model string, out_index int",
    "p5_found": "doc_id bigint, item_id bigint",
    "p7_found": "doc_id bigint, sent_end bigint",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    rows = got.collect()
    assert rows or name == "p2_found"
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)  # each case once
    if name == "p1_found":
        assert all(r["id_a"] < r["id_b"] for r in rows)


def test_packs_hold_every_sequence_once(spark):
    packs = entry.queries()["p4_packs"](spark, FOLDER).toPandas()
    assert not packs.duplicated(["seq_id", "piece"]).any()
    report = entry.queries()["p4_report"](spark, FOLDER).toPandas().set_index("run_name")
    assert packs.groupby("run_name")["seq_id"].nunique().to_dict() == report["n_sequences"].to_dict()
    assert (report["n_packs"] >= report["lower_bound"]).all()
    plan = spark.read.parquet(f"{FOLDER}/pack_plan.parquet").toPandas().set_index("run_name")["pack_length"]
    filled = packs.groupby(["run_name", "pack_id"])["n_tokens"].sum().reset_index()
    assert (filled["n_tokens"] <= filled["run_name"].map(plan)).all()
