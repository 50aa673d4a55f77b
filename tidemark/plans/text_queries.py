"""Corpus preparation: cleaning, ledgers, contamination, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import lexical as L
from tidemark.functions import text as T
from tidemark.functions.lexical import CJK
from tidemark.operators import corpus as C
from tidemark.operators import rules as rulebook

from .catalog import query, table

# The data hold one character that case folding changes and lower case doesn't; for Han and Kana the SQL has its own branch.
SQL_TOKENS = rf"regexp_extract_all(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '([{CJK}])', ' \1 ', 'g'), '[{CJK}]|[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}]*')"
TOK = f"t AS (SELECT doc_id, lang, source, text, {SQL_TOKENS} AS t FROM documents), c AS (SELECT item_id, {SQL_TOKENS} AS t FROM benchmark)"


def sql_grams(src: str, n: int, distinct: bool = False) -> str:
    x = f"[array_to_string(t[i:i+{n - 1}], chr(31)) FOR i IN range(1, len(t) - {n - 2})]"
    return f"list_distinct({x})" if distinct else x


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@query("lexical_tokens", f"WITH {TOK} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first_token, CAST(len(list_distinct(t)) AS INTEGER) AS n_types FROM t")
def lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.size(F.array_distinct("t")).alias("n_types"))


@query("ngram_positions", f"WITH {TOK} SELECT doc_id, CAST(len({sql_grams('t', 12)}) AS INTEGER) AS positions, CAST(len({sql_grams('t', 12, True)}) AS INTEGER) AS distinct_grams FROM t")
def ngram_positions(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", L.keys_of(F.col("text"), 12).alias("g"))
    return d.select("doc_id", F.size("g").alias("positions"), F.size(F.array_distinct("g")).alias("distinct_grams"))


OVERLAP = f"WITH {TOK}, b AS (SELECT DISTINCT unnest({sql_grams('c', 13)}) AS g FROM c), d AS (SELECT doc_id, {sql_grams('t', 13, True)} AS gs FROM t), x AS (SELECT doc_id, unnest(gs) AS g FROM d), s AS (SELECT doc_id, count(*) AS n FROM x SEMI JOIN b USING (g) GROUP BY 1), o AS (SELECT d.doc_id, CAST(len(gs) AS BIGINT) AS distinct_ngrams, coalesce(n, 0) AS shared_ngrams, CASE WHEN len(gs) > 0 THEN round(coalesce(n, 0) / CAST(len(gs) AS DOUBLE), 6) END AS fraction FROM d LEFT JOIN s USING (doc_id)) "


@query("calibration_overlap", OVERLAP + "SELECT *, CASE WHEN distinct_ngrams = 0 THEN 'unscannable' WHEN fraction > 0.05 THEN 'overlap' END AS excluded FROM o")
def calibration_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return C.calibration_overlap(docs(spark, sf), table(spark, sf, "benchmark"), 13)


THRESHOLDS = (0.0, 0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


@query("threshold_sensitivity", OVERLAP + f", h AS (SELECT CAST(unnest({list(THRESHOLDS)}) AS DOUBLE) AS threshold) SELECT threshold, CAST(count(*) FILTER (fraction <= threshold) AS BIGINT) AS kept, CAST(count(*) FILTER (fraction IS NULL OR fraction > threshold) AS BIGINT) AS dropped FROM o, h GROUP BY threshold")
def threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    o = calibration_overlap(spark, sf)
    d = o.select("fraction", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    kept = F.coalesce(F.col("fraction") <= F.col("threshold"), F.lit(False))
    return d.groupBy("threshold").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


AUDIT = f"""WITH {TOK}, b12 AS (SELECT DISTINCT unnest({sql_grams('c', 12)}) AS g FROM c), b5 AS (SELECT DISTINCT unnest({sql_grams('c', 5)}) AS g FROM c),
x AS (SELECT doc_id, unnest({sql_grams('t', 12)}) AS g, generate_subscripts({sql_grams('t', 12)}, 1) - 1 AS pos FROM t),
h AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM x SEMI JOIN b12 USING (g)),
r AS (SELECT doc_id, sum(n) AS hits, max(n) AS longest FROM (SELECT doc_id, isl, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT doc_id, unnest({sql_grams('t', 5)}) AS g, generate_subscripts({sql_grams('t', 5)}, 1) - 1 AS pos FROM t),
n AS (SELECT y.doc_id, y.pos, CASE WHEN b5.g IS NULL THEN 0 ELSE 1 END AS hit FROM y LEFT JOIN b5 USING (g)),
u AS (SELECT doc_id, pos, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n),
st AS (SELECT doc_id, len(t) AS nt, unnest(list_distinct(list_append(range(0, greatest(0, len(t) - 50) + 1, 25), greatest(0, len(t) - 50)))) AS start FROM t WHERE len(t) >= 5),
e AS (SELECT doc_id, start, least(start + 46, nt - 4) - 1 AS stop FROM st),
w AS (SELECT e.doc_id, max((a.upto - coalesce(z.upto, 0)) / CAST(e.stop - e.start + 1 AS DOUBLE)) AS containment FROM e JOIN u a ON a.doc_id = e.doc_id AND a.pos = e.stop LEFT JOIN u z ON z.doc_id = e.doc_id AND z.pos = e.start - 1 GROUP BY 1),
au AS (SELECT t.doc_id, len(t) AS words, CAST(coalesce(hits, 0) AS BIGINT) AS exact_hits, CAST(CASE WHEN longest > 0 THEN longest + 11 ELSE 0 END AS BIGINT) AS longest_run_words, coalesce(containment, 0) AS containment FROM t LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id)) """


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.near_duplicate_audit(docs(spark, sf), table(spark, sf, "benchmark"))


@query("near_duplicate_audit", AUDIT + "SELECT doc_id, words, exact_hits, longest_run_words, round(containment, 9) AS containment FROM au")
def near_duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf).withColumn("containment", F.round("containment", 9))


@query("near_dup_summary", AUDIT + "SELECT count(*) AS documents, round(avg(containment), 9) AS mean, round(quantile_cont(containment, CAST(0.95 AS DOUBLE)), 9) AS p95, round(quantile_cont(containment, CAST(0.99 AS DOUBLE)), 9) AS p99, round(max(containment), 9) AS worst FROM au")
def near_dup_summary(spark: SparkSession, sf: str) -> DataFrame:
    # shares of at most 46 positions: there are no more than some 1,000 different ones, and their counts decide
    c = audit(spark, sf).groupBy("containment").agg(F.count("*").alias("n"))
    q = lambda p: F.round(F.percentile("containment", F.lit(p), F.col("n")), 9)
    mean = F.sum(F.col("containment") * F.col("n")) / F.sum("n")
    return c.agg(F.sum("n").alias("documents"), F.round(mean, 9).alias("mean"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.max("containment"), 9).alias("worst"))


@query("top_near_duplicates", AUDIT + "SELECT doc_id, longest_run_words, round(containment, 9) AS containment FROM au ORDER BY round(containment, 9) DESC, longest_run_words DESC, doc_id LIMIT 20")
def top_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_audit(spark, sf).select("doc_id", "longest_run_words", "containment").orderBy(F.desc("containment"), F.desc("longest_run_words"), "doc_id").limit(20)


@query("contaminated_documents", f"WITH {TOK}, b AS (SELECT DISTINCT unnest({sql_grams('c', 12)}) AS g FROM c), x AS (SELECT DISTINCT doc_id, unnest({sql_grams('t', 12)}) AS g FROM t), p AS (SELECT DISTINCT doc_id FROM x SEMI JOIN b USING (g)) SELECT doc_id, p.doc_id IS NOT NULL AS hit, strlen(text) < 400 AS too_short FROM t LEFT JOIN p USING (doc_id) WHERE p.doc_id IS NOT NULL OR strlen(text) < 400")
def contaminated_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    o = C.calibration_overlap(d, table(spark, sf, "benchmark"), 12).select("doc_id", (F.col("shared_ngrams") > 0).alias("hit"))
    return d.select("doc_id", (F.octet_length("text") < 400).alias("too_short")).join(o, "doc_id").where("hit OR too_short").select("doc_id", "hit", "too_short")


@query("exact_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_occurrence(docs(spark, sf), F.sha2("text", 256), "doc_id")


@query("prior_exclusion", "WITH p AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE source IN ('src0', 'src1')) SELECT doc_id, source FROM documents d WHERE source NOT IN ('src0', 'src1') AND NOT EXISTS (SELECT 1 FROM p WHERE p.h = sha256(d.text)) AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id)")
def prior_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    prior = d.where(F.col("source").isin("src0", "src1"))
    return d.where(~F.col("source").isin("src0", "src1")).join(prior.select("h").distinct(), "h", "left_anti").join(prior.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source")


@query("text_clean", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g') || chr(10)) AS cleaned_sha256 FROM documents")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(T.cleaned(F.col("text")), 256).alias("cleaned_sha256"))


@query("cap_at_newline", r"SELECT doc_id, length(CASE WHEN length(text) > 2000 THEN regexp_replace(substr(text, 1, 2000), '\n[^\n]*\z', '') || chr(10) ELSE text END) AS kept_chars FROM documents")
def cap_at_newline(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.length(T.capped(F.col("text"), 2000)).cast("long").alias("kept_chars"))


@query("ledger_skip_reasons", "WITH r AS (SELECT doc_id, lang, strlen(text) AS bytes, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) SELECT lang AS stratum, CASE WHEN bytes < 400 THEN 'too-short' WHEN rn > 1 THEN 'duplicate-bytes' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1, 2")
def ledger_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first"))
    r = d.join(first, "digest")
    outcome = F.when(F.col("bytes") < 400, "too-short").when(F.col("doc_id") != F.col("first"), "duplicate-bytes").otherwise("kept")
    return r.groupBy(F.col("lang").alias("stratum"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query("slug", r"WITH s AS (SELECT p_partkey, p_name, regexp_replace(substr(regexp_replace(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), 1, 56), '-+$', '') AS s FROM part) SELECT p_partkey, CASE WHEN length(s) < 3 THEN 'h' || substr(sha256(p_name), 1, 12) ELSE s END AS slug FROM s")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("license_strip", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?is)^.*?copyright[^\n]*\n', ''), '(?is)\n[^\n]*licen[sc]e.*$', '')) AS kept_chars FROM documents WHERE regexp_matches(text, '(?i)copyright|licen[sc]e')")
def license_strip(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).where(F.col("text").rlike("(?i)copyright|licen[sc]e"))
    body = F.regexp_replace(F.regexp_replace("text", r"(?is)^.*?copyright[^\n]*\n", ""), r"(?is)\n[^\n]*licen[sc]e.*$", "")
    return d.select("doc_id", F.length(body).cast("long").alias("kept_chars"))


SEC = r"'\bhf_[A-Za-z0-9]{20,}\b'", r"'\bapi_org_[A-Za-z0-9]{20,}\b'", r"'\bsk-[A-Za-z0-9_\-]{20,}\b'", r"'(?i)\btoken=[A-Za-z0-9._\-]{24,}'", r"'(?i)\bauthorization:\s*bearer\s+[A-Za-z0-9._\-]{20,}'"
PLANTED = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' hf_' || sha256(text) WHEN 1 THEN 'token=' || sha256(text) || ' ' || text WHEN 2 THEN 'Authorization: Bearer ' || sha256(text) || ' ' || text ELSE text END AS text FROM documents)"


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, beside half of which stands a synthetic credential: the data hold few."""
    h, k = F.sha2("text", 256), F.col("doc_id") % 6
    return docs(spark, sf).select("doc_id", F.when(k == 0, F.concat("text", F.lit(" hf_"), h)).when(k == 1, F.concat(F.lit("token="), h, F.lit(" "), "text")).when(k == 2, F.concat(F.lit("Authorization: Bearer "), h, F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))


def _nested(expr: str) -> str:
    for s in SEC:
        expr = f"regexp_replace({expr}, {s}, '***REDACTED***', 'g')"
    return expr


@query("secret_redact", f"SELECT doc_id, sha256({_nested('text')}) AS redacted_sha256 FROM {PLANTED}")
def secret_redact(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query("secret_scan", f"SELECT doc_id % 6 AS kind, count(*) AS documents, CAST(count(*) FILTER ({' OR '.join(f'regexp_matches(text, {s})' for s in SEC)}) AS BIGINT) AS with_secret FROM {PLANTED} GROUP BY 1")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).groupBy((F.col("doc_id") % 6).alias("kind")).agg(F.count("*").alias("documents"), F.count_if(T.holds_secret(F.col("text"))).alias("with_secret"))


CREDENTIALS_SQL = f"list_has_any(parts[:-2], {list(T.CREDENTIAL_FOLDERS)}) OR parts[-1] IN {T.CREDENTIAL_FILES + T.CREDENTIAL_FOLDERS} OR regexp_matches(parts[-1], '\\.({'|'.join(e[1:] for e in T.CREDENTIAL_ENDINGS)})$')"
ENDINGS = ("", ".pem", "/.env", "/.ssh/known_hosts", "/tokenizer.json", "/.git/config", "/id_rsa", ".key/readme")


@query("credential_names", f"WITH f AS (SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') || list_extract({list(ENDINGS)}, page_id % {len(ENDINGS)} + 1) AS path FROM pages WHERE url IS NOT NULL), g AS (SELECT *, string_split(path, '/') AS parts FROM f) SELECT page_id, path FROM g WHERE {CREDENTIALS_SQL}")
def credential_names(spark: SparkSession, sf: str) -> DataFrame:
    """Files below each url, some of which publishing would disclose."""
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS)).cast("int"))
    path = F.concat(F.rtrim(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/")), ending)
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", path.alias("path")).where(T.credential_name(F.col("path")))


@query("degenerate_text", r"WITH w AS (SELECT doc_id, trim(text) AS x, [y FOR y IN regexp_split_to_array(trim(text), '\s+') if y <> ''] AS t FROM documents) SELECT doc_id, length(x) < 20 OR len(t) < 8 OR len(list_distinct([array_to_string(t[i:i+3], ' ') FOR i IN range(1, len(t) - 2)])) < CAST(0.3 AS DOUBLE) * len(t) AS degenerate FROM w")
def degenerate_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.degenerate(F.col("text")).alias("degenerate"))


WIN = f"WITH {TOK}, w AS (SELECT doc_id, lang, source, unnest(range(0, len(t) // 64)) AS window_index, t FROM t), x AS (SELECT doc_id, lang, source, window_index, array_to_string(t[window_index * 64 + 1:window_index * 64 + 64], ' ') AS text FROM w) "


@query("token_windows", WIN + "SELECT doc_id, CAST(window_index AS INTEGER) AS window_index, sha256(text) AS token_sha256 FROM x")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_windows(docs(spark, sf), 64).select("doc_id", "window_index", F.sha2("text", 256).alias("token_sha256"))


@query("round_robin_quota", WIN + ", r AS (SELECT lang, doc_id, window_index, row_number() OVER (PARTITION BY lang ORDER BY window_index, doc_id) AS place FROM x) SELECT lang, doc_id, CAST(window_index AS INTEGER) AS window_index, CAST(place AS INTEGER) AS place FROM r WHERE place <= 50")
def round_robin_quota(spark: SparkSession, sf: str) -> DataFrame:
    return C.round_robin(C.token_windows(docs(spark, sf), 64).drop("text"), "lang", 50).select("lang", "doc_id", "window_index", "place")


@query("round_robin_eligible", WIN + f", b AS (SELECT DISTINCT unnest({sql_grams('c', 5)}) AS g FROM c), y AS (SELECT doc_id, lang, window_index, text, string_split(text, ' ') AS t FROM x), z AS (SELECT doc_id, window_index, unnest({sql_grams('t', 5)}) AS g FROM y), hit AS (SELECT DISTINCT doc_id, window_index FROM z SEMI JOIN b USING (g)), f AS (SELECT text, min((window_index, doc_id)) AS first FROM y GROUP BY text), e AS (SELECT y.* FROM y JOIN f ON y.text = f.text AND f.first = (y.window_index, y.doc_id) ANTI JOIN hit ON hit.doc_id = y.doc_id AND hit.window_index = y.window_index), r AS (SELECT lang, doc_id, window_index, row_number() OVER (PARTITION BY lang ORDER BY window_index, doc_id) AS place FROM e) SELECT lang, doc_id, CAST(window_index AS INTEGER) AS window_index, CAST(place AS INTEGER) AS place FROM r WHERE place <= 50")
def round_robin_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that repeat an earlier one, or share a 5-gram with the calibration text, use up their document's turn."""
    w = C.token_windows(docs(spark, sf), 64)
    first = w.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("window_index", "doc_id")).alias("first"))
    hits = C.calibration_overlap(w.select(F.struct("window_index", "doc_id").alias("doc_id"), "text"), table(spark, sf, "benchmark"), 5).where("shared_ngrams > 0").select(F.col("doc_id").alias("at"))
    d = w.select("lang", "doc_id", "window_index", F.struct("window_index", "doc_id").alias("at"), F.sha2("text", 256).alias("digest")).join(first, "digest").where("at = first").join(hits, "at", "left_anti")
    return C.round_robin(d, "lang", 50).select("lang", "doc_id", "window_index", "place")


@query("panel_first_n", f"WITH {TOK}, e AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM t WHERE len(t) >= 128), s AS (SELECT * FROM e WHERE rn <= 4) SELECT lang, doc_id, row_number() OVER (ORDER BY lang, rn) AS window_number FROM s")
def panel_first_n(spark: SparkSession, sf: str) -> DataFrame:
    e = docs(spark, sf).where(F.size(T.tokens(F.col("text"))) >= 128).select("lang", "doc_id")
    s = e.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("rn <= 4")
    return s.select("lang", "doc_id", F.row_number().over(Window.orderBy("lang", "rn")).cast("long").alias("window_number"))  # four rows a stratum


PART = "WITH c AS (SELECT lang, source AS cluster, count(*) AS n, sha256(source) AS k FROM documents GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, row_number() OVER (PARTITION BY lang ORDER BY k) AS rn, count(*) OVER (PARTITION BY lang) AS g FROM c), p AS (SELECT lang, cluster, n, CASE WHEN taken < 20 AND rn < g THEN 'selection' ELSE 'analysis' END AS partition FROM o) "


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = docs(spark, sf).groupBy("lang", F.col("source").alias("cluster")).agg(F.count("*").alias("n")).withColumn("order_key", F.sha2("cluster", 256))
    return C.take_until(c, "lang", 20)


@query("cluster_partition", PART + "SELECT lang, cluster, n, partition FROM p")
def cluster_partition(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(spark, sf).select("lang", "cluster", "n", "partition")


@query("partition_leak", PART + "SELECT cluster, count(DISTINCT partition) AS partitions FROM p GROUP BY cluster HAVING count(DISTINCT partition) > 1")
def partition_leak(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(spark, sf).groupBy("cluster").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


@query("sentinel_sample", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def sentinel_sample(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(25)


@query("html_entries", r"WITH e AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS p FROM pages), c AS (SELECT page_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g')) AS summary FROM e) SELECT page_id, title, sha256(summary) AS summary_sha256, length(summary) AS n_chars FROM c WHERE length(summary) > 500".replace('\\"', '"'))
def html_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.explode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("p"))
    plain = F.regexp_replace("p", "<[^>]*>", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    one = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    c = e.select("page_id", one(F.col("title")).alias("title"), one(plain).alias("summary"))
    return c.where(F.length("summary") > 500).select("page_id", "title", F.sha2("summary", 256).alias("summary_sha256"), F.length("summary").cast("long").alias("n_chars"))


@query("url_target_parse", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]*)/([a-z]+)/([0-9]+)', 1) AS org, regexp_extract(url, '://([^/]*)/([a-z]+)/([0-9]+)', 2) AS name, regexp_extract(url, '://([^/]*)/([a-z]+)/([0-9]+)', 3) AS revision, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_target_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: F.regexp_extract("url", "://([^/]*)/([a-z]+)/([0-9]+)", n)
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), part(1).alias("org"), part(2).alias("name"), part(3).alias("revision"), F.nullif(F.regexp_extract("url", "[?&]ref=([^&#]*)", 1), F.lit("")).alias("ref"))


@query("chat_split", "SELECT conv_id, turn, CASE WHEN instr(x, '</think>') > 0 THEN trim(split_part(x, '</think>', 1)) END AS think, CASE WHEN instr(x, '</think>') > 0 THEN trim(substr(x, instr(x, '</think>') + 8)) ELSE trim(x) END AS answer FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN substr(text, 1, 40) || '</think>' || substr(text, 41) ELSE text END AS x FROM conversations WHERE role = 'assistant')")
def chat_split(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("turn") % 3 == 1, F.concat(F.substring("text", 1, 40), F.lit("</think>"), F.expr("substring(text, 41)"))).otherwise(F.col("text"))
    d = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", x.alias("x"))
    at = F.instr("x", "</think>")
    return d.select("conv_id", "turn", F.when(at > 0, F.trim(F.split_part("x", F.lit("</think>"), F.lit(1)))).alias("think"), F.when(at > 0, F.trim(F.expr("substring(x, instr(x, '</think>') + 8)"))).otherwise(F.trim("x")).alias("answer"))


@query("tensor_classifier", "SELECT CASE WHEN regexp_matches(p_type, '(?i)^promo') THEN 'head' WHEN regexp_matches(p_type, '(?i)steel|brass') THEN 'expert' WHEN regexp_matches(p_type, '(?i)copper|tin') THEN 'attention' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1")
def tensor_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"name": n, "when": {"matches": ["p_type", p]}} for n, p in (("head", "(?i)^promo"), ("expert", "(?i)steel|brass"), ("attention", "(?i)copper|tin"))]
    return table(spark, sf, "part").groupBy(rulebook.first(rules, "other").alias("class")).agg(F.count("*").alias("n"))


TENSOR_NAMES = ("model.embed_tokens.weight", "lm_head.weight", "model.layers.{}.mlp.gate.weight", "model.layers.{}.mlp.experts.7.up_proj.weight", "model.language_model.layers.{}.self_attn.q_proj.weight", "model.layers.{}.self_attn.o_proj.weight", "model.layers.{}.self_attn.q_norm.weight", "model.layers.{}.mlp.down_proj.weight", "model.layers.{}.input_layernorm.weight", "visual.blocks.{}.attn.weight", "model.norm.weight", "model.layers.{}.eh_proj.weight", "model.layers.{}.mlp.shared_experts.up_proj.weight")
TENSOR_KINDS = ("embed_tokens", "lm_head", "moe.router", "moe.experts", "attn.qkv", "attn.o", "attn.other", "mlp.down", "norm", "other", "norm", "mtp", "moe.shared_expert")


@query("tensor_classes", f"SELECT list_extract({list(TENSOR_KINDS)}, p_partkey % {len(TENSOR_NAMES)} + 1) AS class, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def tensor_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as tensors of a decoder, told by their names."""
    name = F.replace(F.get(F.array(*map(F.lit, TENSOR_NAMES)), (F.col("p_partkey") % len(TENSOR_NAMES)).cast("int")), F.lit("{}"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").withColumn("name", name).groupBy(rulebook.tensor_class("name").alias("class")).agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))


@query("window_spans", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS x, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
w AS (SELECT doc_id, i, regexp_matches(x, '[\\p{L}\\p{N}\\p{M}_]') AS w FROM c),
e AS (SELECT *, w AND NOT coalesce(lag(w) OVER d, false) AS opens, w AND NOT coalesce(lead(w) OVER d, false) AS closes FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i - 1 AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e WHERE opens),
b AS (SELECT doc_id, i AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e WHERE closes)
SELECT doc_id, CAST(a.k // 64 AS INTEGER) AS window_index, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(start - coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY a.k), 0) AS INTEGER) AS gap
FROM a JOIN b USING (doc_id) WHERE a.k % 64 = 0 AND b.k = a.k + 63""")
def window_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 64 tokens with the characters of the text that they span."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(L.window_spans(F.col("text"), 64)).alias("w"))
    return d.select("doc_id", "w.window_index", "w.start", "w.stop", "w.gap")


SPLITS = "(SELECT CASE p_size % 3 WHEN 0 THEN 'q' || p_brand || '/part' WHEN 1 THEN 'm' || p_brand ELSE 'mmproj' END || '-0000' || CAST(p_size % 5 + 1 AS VARCHAR) || '-of-00005.gguf' AS f, p_size FROM part)"


@query("split_file_key", f"SELECT CASE WHEN instr(f, '/') > 0 THEN regexp_replace(f, '/[^/]*$', '') ELSE regexp_replace(f, '-[0-9]{{5}}-of-[0-9]{{5}}\\.gguf$', '') END AS build, count(*) AS files, count(DISTINCT f) AS distinct_files FROM {SPLITS} WHERE f NOT LIKE 'mmproj%' AND f LIKE '%.gguf' GROUP BY 1")
def split_file_key(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.concat(F.lit("q"), "p_brand", F.lit("/part"))).when(size % 3 == 1, F.concat(F.lit("m"), "p_brand")).otherwise("mmproj")
    f = table(spark, sf, "part").select(F.concat(name, F.lit("-0000"), (size % 5 + 1).cast("string"), F.lit("-of-00005.gguf")).alias("f")).where("f NOT LIKE 'mmproj%' AND f LIKE '%.gguf'")
    build = F.when(F.instr("f", "/") > 0, F.regexp_replace("f", "/[^/]*$", "")).otherwise(F.regexp_replace("f", r"-[0-9]{5}-of-[0-9]{5}\.gguf$", ""))
    return f.groupBy(build.alias("build")).agg(F.count("*").alias("files"), F.count_distinct("f").alias("distinct_files"))


@query("title_blocklist", "WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) SELECT min(page_id) AS page_id, title FROM t WHERE NOT regexp_matches(title, '(?i)!!|###|\\$\\$\\$|^list of') AND instr(title, ':') = 0 GROUP BY title".replace("\\\\", "\\"))
def title_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return t.where(~F.col("title").rlike(r"(?i)!!|###|\$\$\$|^list of") & (F.instr("title", ":") == 0)).groupBy("title").agg(F.min("page_id").alias("page_id"))


def _packed(batches):
    """Paragraph units over ``least`` characters fill a context; a unit that doesn't fit starts the next."""
    import pandas as pd

    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            filled, n = 0, 0
            for unit in (u for u in (text or "").split("\n") if len(u) > 100):
                if n and filled + len(unit) > 1200:
                    out.append((doc, n, filled))
                    filled, n = 0, 0
                filled, n = filled + len(unit), n + 1
            if n:
                out.append((doc, n, filled))
        yield pd.DataFrame(out, columns=["doc_id", "units", "chars"])


@query("paragraph_packing")
def paragraph_packing(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", "text").mapInPandas(_packed, "doc_id long, units int, chars int")
