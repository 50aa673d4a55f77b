"""URL filters by a sort-merge range join, in DataFrame expressions only.

A host becomes its labels in reverse, each ended by a dot (``www.a.com`` -> ``com.a.www.``), so a rule's host
covers one interval of that order: every key that begins with its own.  Such intervals nest and never
cross.  Bounds and urls are sorted together and swept once: behind a host's opening bound the stack of active
hosts is that host and those around it, behind its closing bound the stack is that of the hosts around it.  A
url takes the stack of the bound last swept: at most one host for each of its labels.

Paths are prefixes too, so among the rules of one host they are intervals that nest.  A second sweep, over (host of
the rule, path), gives a url the innermost of them by the bound last swept, however many rules a host has.
The longest over the url's hosts wins.

Both sweeps run in parts: the first in blocks of the order (the first two labels and the beginning of the third),
which start with the stack that is active there, the second by host of the rule.  Both are counted, and dealt out
over as many equal parts as they need to have at most ``part_rows`` urls, or half a shuffle partition's share if that is
less, so a host with a third of all urls is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, written

FEW_HOSTS = 1 << 17  # hosts of rules that may go to every task


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def behind(prefix: Column) -> Column:
    """A bound behind everything that begins with ``prefix``: a byte that UTF-8 never holds.  Bounds are compared as bytes."""
    return F.concat(prefix.cast("binary"), F.unhex(F.lit("FF")))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def prefixes_of(key: Column) -> Column:
    """The keys of the host that ``key`` stands for and of every host above it."""
    labels = F.split(key, r"\.")  # ends with an empty label
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))


def block_of(key: Column) -> Column:
    """The first two labels, and two characters of the third: coarser than the order, and along it."""
    labels = F.split(key, r"\.")
    return F.concat_ws(".", F.coalesce(F.get(labels, F.lit(0)), F.lit("")), F.coalesce(F.get(labels, F.lit(1)), F.lit("")), F.substring(F.coalesce(F.get(labels, F.lit(2)), F.lit("")), 1, 2))


def _hosts_above(above: DataFrame, hosts: DataFrame, few: bool, part_rows: int) -> DataFrame:
    """The rows of ``above`` whose ``rkey`` is a host of a rule.

    Few hosts go to every task.  Of many, those that more than ``part_rows`` rows ask for go to every task (there are
    at most rows / ``part_rows`` of them), and the rest is joined: no key brings many rows to one task.
    """
    if few:
        return above.join(F.broadcast(hosts), "rkey")
    asked = above.groupBy("rkey").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).select("rkey")
    heavy = F.broadcast(written(asked, "heavy-hosts"))
    often = F.broadcast(hosts.join(heavy, "rkey", "left_semi"))
    return above.join(heavy, "rkey", "left_anti").join(hosts, "rkey").unionByName(above.join(often, "rkey"))


def _stacks(keys: DataFrame, hosts: DataFrame, strict: bool, few: bool, part_rows: int) -> DataFrame:
    """For each key of ``keys``, the hosts of rules at and above it (``strict``: only above)."""
    above = keys.select("key", F.explode(prefixes_of(F.col("key"))).alias("rkey"))
    if strict:
        above = above.where("rkey <> key")
    found = _hosts_above(above, hosts, few, part_rows).groupBy("key").agg(F.collect_list("rkey").alias("stack"))
    return keys.join(found, "key", "left").select("key", F.coalesce("stack", F.array().cast("array<string>")).alias("stack"))


def _dealt(urls: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """``urls`` with ``salt``: its part of those that ``sizes`` (``by``, ``parts``) asks for.

    Only what needs several parts is broadcast: there are at most rows / ``part_rows`` of that.  Urls without ``by``
    meet no bound and are spread.
    """
    several = F.broadcast(sizes.where("parts > 1").select(by, "parts"))
    parts = F.when(F.col(by).isNull(), F.lit(1 << 16)).otherwise(F.coalesce("parts", F.lit(1)))
    return urls.join(several, by, "left").withColumn("salt", F.pmod(F.xxhash64("row"), parts)).drop("parts")


def _parts(n: str, part_rows: int) -> Column:
    return F.ceil(F.col(n) / part_rows).alias("parts")


def _each_part(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def _rule_hosts(urls: DataFrame, hosts: DataFrame, few: bool, part_rows: int) -> DataFrame:
    """The first sweep: ``urls`` with ``active``, the hosts of rules that fit a url's host."""
    keyed = urls.withColumn("block", block_of(F.col("key")))
    start = F.concat(F.array_join(F.slice(F.split("key", r"\."), 1, 2), "."), F.lit("."))
    sizes = keyed.groupBy("block").agg(F.first(start).alias("start"), F.count("*").alias("n")).select("block", "start", _parts("n", part_rows))
    blocks = _each_part(sizes)

    # where a block begins: the hosts above it that were opened in an earlier block
    entry = _stacks(blocks.select(F.col("start").alias("key")).distinct(), hosts, False, few, part_rows).withColumnRenamed("key", "start")
    begins = blocks.join(entry, "start").select("block", "salt", F.lit("").cast("binary").alias("at"), F.lit(0).alias("kind"), "stack")

    # bounds within the blocks: one opening and one closing key per host
    keys = hosts.select(F.col("rkey").alias("key"))
    opens = _stacks(keys, hosts, False, few, part_rows).select("key", F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"), "stack")
    closes = _stacks(keys, hosts, True, few, part_rows).select("key", behind(F.col("key")).alias("at"), F.lit(3).alias("kind"), "stack")
    bounds = opens.unionByName(closes).withColumn("block", block_of(F.col("key"))).join(blocks.select("block", "salt"), "block")

    none = F.lit(None)
    events = begins.unionByName(bounds.select(*begins.columns)).select("*", *(none.cast(f.dataType).alias(f.name) for f in urls.schema))
    events = events.unionByName(_dealt(keyed, sizes, "block").withColumns({"at": F.col("key").cast("binary"), "kind": F.lit(2), "stack": none.cast("array<string>")}))
    sweep = Window.partitionBy("block", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2").select(*urls.columns, "active")


def _innermost(pairs: DataFrame, rules: DataFrame, part_rows: int) -> DataFrame:
    """The second sweep: ``pairs`` of a url and the host of a rule with ``rule``, that host's longest for the url's path."""
    sizes = pairs.where("rkey IS NOT NULL").groupBy("rkey").agg(F.count("*").alias("n")).select("rkey", _parts("n", part_rows))

    length = F.length("path")
    inner = rules.select("rkey", "path", F.explode(F.when(length > 0, F.sequence(F.lit(0), length - 1))).alias("cut")).select("rkey", "path", F.substring("path", F.lit(1), F.col("cut")).alias("outer"))
    outer = inner.join(rules.select("rkey", F.col("path").alias("outer"), F.col("rule").alias("around")), ["rkey", "outer"]).groupBy("rkey", "path").agg(F.max_by("around", F.length("outer")).alias("around"))
    nothing = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema["rule"].dataType))
    opens = rules.select("rkey", F.col("path").cast("binary").alias("at"), F.lit(1).alias("kind"), F.col("rule").alias("bound"))
    closes = rules.join(outer, ["rkey", "path"], "left").select("rkey", behind(F.col("path")).alias("at"), F.lit(3).alias("kind"), F.coalesce("around", nothing).alias("bound"))
    bounds = opens.unionByName(closes).join(_each_part(sizes), "rkey")

    none = F.lit(None)
    events = bounds.select("*", *(none.cast(f.dataType).alias(f.name) for f in pairs.schema if f.name != "rkey"))
    events = events.unionByName(_dealt(pairs, sizes, "rkey").withColumns({"at": F.col("path").cast("binary"), "kind": F.lit(2), "bound": none.cast(rules.schema["rule"].dataType)}))
    sweep = Window.partitionBy("rkey", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("rule", F.last("bound", ignorenulls=True).over(sweep)).where("kind = 2").select(*pairs.columns, "rule")


def url_verdicts(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", part_rows: int = 1 << 20, few_hosts: int = FEW_HOSTS) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``rule_host``, ``rule_path`` and ``action``.  A rule fits its host and
    all subdomains if the url's path begins with its path; the rule longest in characters
    wins, of equals the first in alphabetical order, of repeats ``block``.  No rule:
    ``rule`` is null and the verdict ``default``.  Null urls and urls without ``://`` have
    an empty host and path.  Empty tables give empty results; repeated rows stay; other
    columns of ``pages`` are not read, whatever their names.  ``pages`` is read once: hosts and paths are written
    to the shared folder.
    """
    rules = (
        rules.select(F.translate("rule_host", ASCII_UPPER, ASCII_LOWER).alias("host"), F.coalesce("rule_path", F.lit("")).alias("path"), "action")
        .where("host is not null")
        .groupBy(key_of(F.col("host")).alias("rkey"), "host", "path")
        .agg(F.min(F.struct((F.col("action") != "block").alias("later"), "action")).alias("first"))
        .select("rkey", "path", F.struct((-F.length(F.concat("host", "path"))).alias("size"), F.concat("host", "path").alias("name"), F.col("first.action").alias("action")).alias("rule"))
    )
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = written(urls.withColumn("key", key_of(F.col("host"))), "urls")
    part_rows = min(part_rows, max(32, urls.count() // (2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    hosts = rules.select("rkey").distinct()
    few = hosts.count() <= few_hosts
    swept = _rule_hosts(urls, hosts, few, part_rows).select("row", "id", "host", "path", F.explode_outer("active").alias("rkey"))
    judged = _innermost(written(swept, "swept"), rules, part_rows)
    best = judged.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(F.when(F.col("rule.name").isNotNull(), F.col("rule"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``[("block", "example.com/en/"), ...]`` as a rule table; a rule's path begins at its first slash."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("rule_host"), F.lit("/" + r.partition("/")[2] if "/" in r else "").alias("rule_path"), F.lit(a).alias("action")) for a, r in rules or [("", "")]]
    return spark.range(1).select(F.inline(F.array(*rows))).where(F.lit(bool(rules)))
