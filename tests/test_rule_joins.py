"""Which other rows the registry's rules are joined with, and where."""

from tidemark.operators import constraints as C


def planned(spark, *codes):
    frames = {name: spark.createDataFrame([], schema) for name, schema in C.SCHEMAS.items()}
    return C.violations(frames, ["note"], codes=codes)._jdf.queryExecution().analyzed().toString()


def test_rules_that_look_at_no_other_row_are_judged_without_a_join(spark):
    for code in ("DISC", "DET", "STAT", "PROV-00"):
        plan = planned(spark, code)
        assert plan.count("Join") == (1 if code == "PROV-00" else 0), code  # PROV-008 looks at the pipeline


def test_only_the_references_that_a_rule_looks_at_are_joined(spark):
    plan = planned(spark, "IDENT-001")
    assert plan.count("Join") == 1
    assert planned(spark, "PANEL-006").count("Join") == 1


def test_a_lookup_by_a_reference_that_most_rows_lack_leaves_these_rows_out(spark):
    d = spark.createDataFrame([("x", None), ("y", "x"), ("z", "gone")], "id string, up string")
    (out,) = C.judged(d, "row", [("REF", "error", C.unresolved("up", "parent", True))], ("parent",), parent=("up", d))
    assert [r["id"] for r in out.collect()] == ["z"]
    assert "isnotnull(up" in out._jdf.queryExecution().optimizedPlan().toString()
