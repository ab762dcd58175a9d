"""The problems' queries against their SQL, and the plans of encoding."""

import glob
import math
import os

import duckdb
import pytest

from vitagraph.llm import registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    def cell(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    names = sorted(df.columns)
    return sorted("|".join(map(cell, r)) for r in df[names].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


@needs_data
def test_encoding_has_one_plan(spark):
    plans = []
    for partitions in ("4", "400"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            plans.append(registry.queries()["p8_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plans == [0, 0]
