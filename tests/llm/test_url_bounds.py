"""op2: bounds that no url can equal, and hosts that very many urls ask for."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, url_filter

from .test_pages_and_chats import URLS, verdict

END = "\U0010ffff"
HARD = [f"http://example.com/en/{END}a", f"http://x.net/es/{END}{END}", f"http://{END}.example.com/en/x", f"http://example.com{END}/en/x", f"http://a{END}.net/es/{END}", f"http://net/es/{END}", f"http://net/es{END}/", "http://example.com/en/\U0010fffe", "http://net/es/\x7f", "http://www.example.com/en/퟿"]


@pytest.mark.parametrize("few_hosts", [0, 1 << 17])
@pytest.mark.parametrize("part_rows", [2, 1 << 20])
def test_the_last_character_of_all(spark, few_hosts, part_rows):
    rules = [*queries.URL_RULES, ("block", f"{END}.example.com/"), ("block", f"example.com/en/{END}"), ("allow", f"net/es/{END}{END}")]
    urls = [*HARD, *URLS] * 2
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, url_filter.url_verdicts(d, url_filter.rules_frame(spark, rules), part_rows=part_rows, few_hosts=few_hosts).collect()))
    assert str(got) == str(sorted((i, *verdict(u, rules, "allow")) for i, u in enumerate(urls)))


@pytest.mark.parametrize("few_hosts", [0, 1 << 17])
def test_a_hundred_thousand_hosts_under_one_parent(spark, few_hosts):
    d = spark.range(100_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".example").otherwise(""), F.lit(".com/en/"), F.col("id").cast("string")).alias("url"))
    rules = [*queries.URL_RULES, *(("block", f"s{i}.com/en/") for i in range(0, 300, 7))]
    out = url_filter.url_verdicts(d, url_filter.rules_frame(spark, rules), part_rows=5000, few_hosts=few_hosts)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == 100_000
    for i in [*range(400), *random.Random(3).sample(range(100_000), 300)]:
        url = f"http://s{i}{'.example' if i % 3 == 0 else ''}.com/en/{i}"
        assert got[i] == verdict(url, rules, "allow")
