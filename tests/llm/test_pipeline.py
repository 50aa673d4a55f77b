"""Each stage against its operator, on its own input."""

import corpus_pipeline as P
from tidemark.llm import best_fit, decontaminate, quality_rules, simhash, toxicity
from tidemark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.schema == docs.schema
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert out.count() == len(ids)
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
        elif name == "toxicity":
            from pyspark.sql import functions as F

            model = toxicity.learn(docs, table(spark, SF, "labels"), ~(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2))
            want = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
        elif name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        else:
            hit = {r["doc_id"] for r in decontaminate.contaminated(docs, table(spark, SF, "benchmark")).collect()}
            assert hit
            want = {r["doc_id"] for r in docs.collect()} - hit
        assert ids == want, name
        seen.append(len(ids))
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_equals_the_stages_one_after_the_other(spark):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    a, b = sorted(map(key, P.run(spark, SF).collect())), sorted(map(key, P.run(spark, SF).collect()))
    assert a == b and len(a) > 50


def test_names_and_modules():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    assert P.ORACLE_SQL is None and best_fit.pack


def tables(spark, folder, docs):
    """A folder with ``docs`` and small other tables; labels have nulls, repeats and conflicts."""
    from .fixtures import prose

    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k % 40, k % 2, (k // 2) % 2 if k % 7 else None) for k in range(50)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 200)[100:400]), (2, None), (3, ""), (1, "again and again")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_every_stage_takes_awkward_rows(spark, tmp_path):
    from .fixtures import documents

    docs = documents(spark)
    sf = tables(spark, tmp_path, docs)
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        assert {r["doc_id"] for r in out.collect()} <= ids
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, sf).collect()} == ids
    kept = {r["doc_id"] for r in decontaminate.clean(docs, table(spark, sf, "benchmark")).collect()}
    assert kept == ids - {2}
    assert P.run(spark, sf).count() > 0


def test_every_stage_takes_empty_tables(spark, tmp_path):
    from .fixtures import empty

    docs = empty(spark)
    sf = tables(spark, tmp_path, docs)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema and out.count() == 0, name
    assert P.run(spark, sf).count() == 0
