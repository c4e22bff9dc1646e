"""Every query of the catalogue against its SQL, and the plans that must not appear."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    columns = sorted(a.columns)
    if columns != sorted(b.columns) or len(a) != len(b):
        return False
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (a, b))
    return all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in columns)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.oracle_sql()])
def test_query_equals_sql(spark, data, sql, name):
    assert same(catalog.queries()[name](spark, data).toPandas(), sql.execute(catalog.oracle_sql()[name]).df())


def test_registration_leaves_no_residual(spark, data):
    assert catalog.queries()["icp_transform"](spark, data).where("error > 1e-6").count() == 0


@pytest.mark.parametrize("name", ["knn_k3", "radius_search", "rect_overlap_join", "segment_intersections", "point_in_polygon", "mesh_edges", "voxel_exposed_area"])
def test_no_cartesian_product(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_only_what_is_used(spark, data):
    plan = catalog.queries()["ring_bounds"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" not in plan and "c_name" not in plan


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
