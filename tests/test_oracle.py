"""Queries against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: One of each family; the driver compares all of them.
NAMES = ["rtn_quantize", "token_kld", "masked_vs_full_kld", "offset_audit", "placement_audit", "pooled_variance", "determinism_verdict", "histogram_quantile_bounds", "stratified_fpc", "calibration_overlap", "near_duplicate_audit", "round_robin_quota", "text_clean", "secret_redact", "floor_violations", "lineage_walk", "transition_violations", "domain_table", "wilcoxon_ranks", "decode_q8_0", "trellis_states", "trellis_energy", "identity_disagreements"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 8)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, db, name):
    got, want = plans.QUERIES[name](spark, SF), db.sql(plans.ORACLE[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = sorted((str(tuple(plain(r[c]) for c in cols)) for r in got.collect()))
    assert rows == sorted(str(tuple(plain(r[want.columns.index(c)]) for c in cols)) for r in want.fetchall())


def test_every_query_is_named_once_and_sql_belongs_to_a_query():
    assert len(plans.QUERIES) > 120
    assert not plans.ORACLE.keys() - plans.QUERIES.keys()
