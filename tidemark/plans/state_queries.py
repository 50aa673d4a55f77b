"""Work in sealed parts, guarded histories, registered literals, documents in canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import documents as J
from tidemark.functions import text as T
from tidemark.operators import guarded, literals, resume
from tidemark.operators.shared import shared_path

from .catalog import query, table


@query("resumed_totals", "SELECT CAST(l_suppkey % 16 AS VARCHAR) AS part, l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, l_suppkey % 16 < 5 AND l_suppkey % 16 <> 3 AS reused FROM lineitem WHERE NOT (l_suppkey % 16 = 2 AND l_returnflag = 'R') GROUP BY ALL")
def resumed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by supplier group; a run got to five of sixteen parts, and since then the rows of part 3 changed."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("p"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q")).where("NOT (p = 2 AND flag = 'R')")
    folder = shared_path(spark, "resumed-totals")

    def totals(some: DataFrame) -> DataFrame:
        return some.groupBy(F.col("p").cast("string").alias("part"), "flag").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))

    params = {"columns": ["l_quantity"], "by": ["l_suppkey % 16", "l_returnflag"]}
    before = rows.where("p < 5").withColumn("q", F.when(F.col("p") == 3, F.col("q") + 1).otherwise(F.col("q")))
    for some in (before, rows):
        out = resume.resumed(some, "p", totals, "flag string, n long, quantity long", folder, params, groups=4)
    return out.select("part", "flag", "n", "quantity", "reused")


@query("guarded_ledger", """WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'reserve' WHEN event_type = 'view' THEN 'touch' ELSE 'release' END AS kind, CAST(round(value * 100) AS BIGINT) AS amount FROM events),
x AS (SELECT *, CASE WHEN seq % 4 = 0 THEN seq - 1 - seq // 8 WHEN seq % 9 = 0 THEN 0 END AS expected FROM e),
w(user_id, seq, verdict, generation, reserved) AS (
  SELECT user_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, seq, verdict, generation + CAST(verdict = 'applied' AS BIGINT), CASE WHEN verdict = 'applied' THEN after ELSE reserved END FROM (
    SELECT x.user_id, x.seq, w.generation, w.reserved, w.reserved + CASE kind WHEN 'reserve' THEN amount WHEN 'release' THEN -amount ELSE 0 END AS after,
      CASE WHEN expected <> w.generation THEN 'stale' WHEN kind <> 'touch' AND (amount IS NULL OR amount < 0) THEN 'invalid' WHEN kind = 'reserve' AND w.reserved + amount > 20000 THEN 'over the cap' WHEN kind = 'release' AND amount > w.reserved THEN 'over-release' ELSE 'applied' END AS verdict
    FROM w JOIN x ON x.user_id = w.user_id AND x.seq = w.seq + 1))
SELECT user_id, seq, verdict, generation, reserved FROM w WHERE seq > 0""")
def guarded_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as reservations and releases in cents under a cap, some of which expect a generation."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t.isin("purchase", "click"), "reserve").when(t == "view", "touch").otherwise("release")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = e.select("user_id", seq.alias("seq"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    expected = F.when(F.col("seq") % 4 == 0, F.col("seq") - 1 - F.floor(F.col("seq") / 8)).when(F.col("seq") % 9 == 0, F.lit(0))
    return guarded.folded(e.withColumn("expected", expected.cast("long")), 20_000, key="user_id")


@query("literal_redact", """WITH w AS (SELECT list(DISTINCT substr(text, 11, 24)) AS ws FROM benchmark)
SELECT doc_id, list_reduce(list_prepend(text, ws), lambda t, x: replace(t, x, '***REDACTED***')) AS clean, CAST(list_sum(list_transform(ws, lambda x: (length(text) - length(replace(text, x, ''))) // 24)) AS INTEGER) AS spans
FROM documents CROSS JOIN w""")
def literal_redact(spark: SparkSession, sf: str) -> DataFrame:
    """A stretch of each benchmark item as a secret that was registered, taken out of all documents."""
    words = table(spark, sf, "benchmark").select(F.substring("text", 11, 24).alias("w"))
    out = literals.redacted(table(spark, sf, "documents").select("doc_id", "text"), "text", literals.registered(words, "w"))
    return out.select("doc_id", F.col("text").alias("clean"), F.size("spans").alias("spans"))


@query("canonical_documents", """SELECT s_suppkey, '{"account":' || CAST(s_nationkey AS VARCHAR) || ',"name":"' || s_name || '","nested":{"a":[' || CAST(s_suppkey AS VARCHAR) || ',true,null],"b":{"path":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '"rel/' || CAST(s_suppkey AS VARCHAR) || '"' END || '}}}' AS json, CASE WHEN s_suppkey % 3 = 0 THEN 'nested.b.path' ELSE '' END AS removed FROM supplier""")
def canonical_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as documents with keys out of order and blanks, some with a path of the writing host."""
    path = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/data/"), "s_name")).otherwise(F.concat(F.lit("rel/"), F.col("s_suppkey").cast("string")))
    text = F.format_string('{ "nested": {"b": {"path": "%s"}, "a": [%d, true, null]}, "name": "%s",\n "account": %d}', path, F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey"))
    d = table(spark, sf, "supplier").select("s_suppkey", J.stripped(text).alias("d"))
    return d.select("s_suppkey", "d.json", F.array_join("d.removed", ",").alias("removed"))


@query("document_seals", """SELECT s_suppkey, s_suppkey % 13 <> 0 AS sealed FROM supplier""")
def document_seals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that carry the digest of their canonical spelling; some were changed afterwards."""
    body = lambda seal, nation: F.concat(F.lit('{"name":"'), "s_name", F.lit('","nation":'), nation.cast("string"), F.lit(',"seal":"'), seal, F.lit('"}'))
    nation = F.col("s_nationkey")
    later = nation + F.when(F.col("s_suppkey") % 13 == 0, 1).otherwise(0)
    d = table(spark, sf, "supplier").select("s_suppkey", body(F.sha2(body(F.lit(""), nation), 256), later).alias("text"))
    return d.select("s_suppkey", J.sealed(F.col("text"), "seal").alias("sealed"))


@query("private_paths", """SELECT doc_id, regexp_matches(text, '/home/|/root/|/Users/|/private/|/tmp/|/workspace/|/mnt/c/Users/|file:///|:\\\\{1,2}Users\\\\{1,2}|\\\\/(home|root|Users|private|tmp|workspace)\\\\/') AS private FROM documents""")
def private_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.private_path(F.col("text")).alias("private"))
