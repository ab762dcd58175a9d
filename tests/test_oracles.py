"""Every query against its SQL on the smallest tables, and a smoke run of the rest."""

import glob
import math
import os

import duckdb
import pytest

from vitagraph import registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "item"):
        return cell(v.item())
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(df):
    return sorted("|".join(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_queries_read_whole_case_texts(spark, tmp_path):
    """Entities of sentences without an edge, and of cases without any, are found."""
    at = "timestamp'2024-01-01'"
    for name, sql in {
        "cases": f"select 1L as row_id, 'P1_01' as case_id, 'He had fever. Later he took aspirin.' as case_text, {at} as loaded_at union all select 2L, 'P2_01', 'No edge here\\nbut fever of 39 C', {at}",
        "v4_nodes": "select 'fever' as label, 'Symptom' as type union all select 'aspirin', 'Medication'",
        "v2_edges_gemini": f"select 'P1' as source_id, 'S:fever' as target_id, 'PRESENTS_WITH' as relation, 'P1_01' as case_id, 1 as sentence_number, 'He had fever.' as sentence, {at} as loaded_at",
    }.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run(registry.FLAGSHIP)} == {("Symptom", 2, 2), ("Medication", 1, 1)}
    assert {(r.case_id, r.sentence_number, r.target_id.split(":")[1]) for r in run("g14_star_edges")} >= {("P1_01", 1, "fever"), ("P1_01", 2, "aspirin"), ("P2_01", 2, "fever")}
