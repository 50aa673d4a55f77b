"""Queries run over their whole tables."""

import pytest

from tidemark import plans

from .test_oracle import SF, db, plain  # noqa: F401


@pytest.fixture
def agreed(spark, db):  # noqa: F811
    """The rows of a query, after they were found equal to those of its SQL."""

    def run(name, sf=SF):
        got, want = plans.QUERIES[name](spark, sf), db.sql(plans.ORACLE[name])
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        rows = got.collect()
        assert sorted(str(tuple(plain(r[c]) for c in cols)) for r in rows) == sorted(str(tuple(plain(r[want.columns.index(c)]) for c in cols)) for r in want.fetchall())
        return rows

    return run


def test_secrets_are_sought_in_whole_texts(spark, agreed, tmp_path):
    from tidemark.plans.text_queries import planted

    agreed("secret_redact"), agreed("secret_scan")
    secret = "sk-" + "a1" * 12
    d = spark.createDataFrame([(k, f"{'word ' * 100}{secret} end", "en", "s") for k in range(6)], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in planted(spark, str(tmp_path)).collect()}
    assert all(secret in t and t.count("word") == 100 for t in texts.values())
    assert {r["kind"]: r["with_secret"] for r in plans.QUERIES["secret_scan"](spark, str(tmp_path)).collect()} == dict.fromkeys(range(6), 1)


def test_every_supplier_has_a_class(spark, agreed, tmp_path):
    assert len(agreed("comparison_class")) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    s = spark.createDataFrame([(k, 1, "same" if k in (5000, 1) else f"n{k}") for k in (1, 2, 150, 999, 1000, 5000)], "s_suppkey long, s_nationkey int, s_name string")
    s.write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["id"]: r["class"] for r in plans.QUERIES["comparison_class"](spark, str(tmp_path)).collect()}
    assert got == {1: "run-to-run floor", 2: "run-to-run floor", 150: "reproduction", 999: "reproduction", 1000: "run-to-run floor", 5000: "reproduction"}


def test_every_row_is_replayed_and_audited(spark, agreed):
    n = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    rows = plans.QUERIES["hidden_replay"](spark, "/root/testdata/sf0.01")
    assert n > 100 and rows.count() == 32 * n
    agreed("hidden_replay"), agreed("placement_audit")


def test_a_misplaced_row_past_the_first_hundred_is_audited(spark):
    from tidemark.operators import scoring

    unit = [[float(i == k) for i in range(600)] for k in range(600)]
    moved = [*unit[:300], *unit[301:], unit[300]]
    d = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(zip(unit, moved, strict=True))], "vec_id long, teacher array<double>, candidate array<double>")
    r = scoring.placement_audit(d, shifts=(1, 8, 64, 512)).first()
    assert not r["passed"] and r["aligned"] == 1.0


def test_a_walk_starts_from_every_part(spark, agreed):
    starts = {r["start"] for r in agreed("lineage_walk")}
    assert len(starts) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_a_head_in_blocks_gives_the_same_logits(spark):
    from tidemark.operators import scoring

    hidden = spark.createDataFrame([(k, [k / 7, 1.0 - k]) for k in range(20)], "vec_id long, v array<double>")
    head = spark.createDataFrame([(k, [k + 0.5, k / 3]) for k in range(9)], "token long, w array<double>")
    whole, blocks = (sorted(map(tuple, scoring.replay(hidden, head, head_bytes=n).collect())) for n in (1 << 20, 40))
    assert whole == blocks and len(whole) == 180
