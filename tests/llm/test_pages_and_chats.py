"""Pages, urls and conversations: against plain Python and in awkward cases."""

import hashlib
import random

import duckdb
import pytest

from tidemark.llm import chat_format, html_extract, queries, url_filter

# --- html -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>One <b>bold</b>word&nbsp;here.<br>Next<p>Two</article><footer>f</footer>", "A title One boldword here. Next Two"),
        ("<body><div class='content'><p>" + "long text " * 30 + "<p>tail</div><div class='sidebar'><p>" + "aside text " * 30 + "</div>", ("long text " * 30).strip() + " tail"),
        ("<article><p>a</p><div class='ad-slot'>buy</div><script>var x='</p>';</script><form>f<input></form><p>b</p><section id='comments'><p>c</p></section></article>", "a b"),
        ("<main><p>kept<div hidden>no</div><p style='display:none'>no<p>too</main>", "kept too"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<script>only()</script>", ""),
        ("<main><article><p>" + "story " * 40 + "</article><div><p>more from us</div></main>", ("story " * 40).strip()),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


def test_extract_defines_every_row(spark):
    d = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a", "x"), (2, None, "", "x"), (3, "u", "<p>" + "w " * 200_000, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(d).collect()
    assert sorted(((r["page_id"] or 0, r["n_chars"]) for r in got)) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 399_999)]
    assert html_extract.extract(d.limit(0)).count() == 0


# --- urls -----------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://a.b.example.com/en/x", "http://notexample.com/en/x", "http://x.net/es/1", "http://net/fr/", "http://x.net/esp", "http://x.org/en/", "a://b://c/d", "http:///path", "http://.com/", "http://www.example.com?/en/", "http://x.com:80/a", "http://www.example.com/en/1\n2"]


def verdict(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c < "\x80" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for action, rule in rules:
        h, p = rule.partition("/")[0], "/" + rule.partition("/")[2]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best and best[1], best[0] if best else default


def test_urls_match_brute_force(spark):
    rules = [*queries.URL_RULES, ("block", "b.example.com/"), ("allow", "a.b.example.com/en/x"), ("block", "org/")]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    want = sorted((i, *verdict(u, rules, "allow")) for i, u in enumerate(URLS * 3))
    for part_rows in (2, 1 << 20):
        got = sorted(map(tuple, url_filter.url_verdicts(d, url_filter.rules_frame(spark, rules), part_rows=part_rows).collect()))
        assert str(got) == str(want)


def test_nested_path_rules_match_brute_force(spark):
    rng = random.Random(2)
    path = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    host = lambda: ".".join(rng.choice("xyz") for _ in range(rng.randrange(1, 4)))
    rules = sorted({h + p: (rng.choice(["allow", "block"]), h + p) for h, p in ((host(), path(5)) for _ in range(150))}.values(), key=lambda r: r[1])
    urls = [f"http://{host()}{path(8)}?q" for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted((i, *verdict(u, rules, "allow")) for i, u in enumerate(urls))
    for part_rows in (7, 1 << 20):
        got = sorted(map(tuple, url_filter.url_verdicts(d, url_filter.rules_frame(spark, rules), part_rows=part_rows).collect()))
        assert str(got) == str(want)


def test_urls_without_rules_or_rows(spark):
    d = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_filter.rules_frame(spark, queries.URL_RULES).limit(0)
    assert [tuple(r) for r in url_filter.url_verdicts(d, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filter.url_verdicts(d.limit(0), url_filter.rules_frame(spark, queries.URL_RULES)).count() == 0


# --- chats ----------------------------------------------------------------------------------

HARD = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<", "|>", "", "a\nb", "<|turn|>", "<|nl|>", "ends with <", None, "$1 \\1"]


def test_chats_read_back_exactly(spark):
    rows = []
    for c in range(30):
        for t in range(c % 7 + 1):
            rows.append((c if c != 5 else None, t if (c + t) % 11 else None, ["user", "assistant", "assistant", None, "sys\ntem<|im_start|>"][(c * 3 + t * t) % 5], HARD[(c * 5 + t) % len(HARD)], "clash"))
    rows += [(3, 0, "user", "again", "x")] * 2
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(d)
    got = out.select("conv_id", chat_format.read_turns(out["formatted"]).alias("turns"), chat_format.loss_text(out["segments"]).alias("loss"), "formatted", "segments").collect()
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert {r["conv_id"] for r in got} == set(by)
    for r in got:
        want = [(a, b) for _, _, a, b in sorted(by[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(b for a, b in want if a == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        merged = sum(i == 0 or want[i - 1][0] != a for i, (a, _) in enumerate(want))
        assert r["formatted"].count("<|im_start|>") == merged
    assert chat_format.format_chats(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        db.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    digest = lambda rows: hashlib.sha256("\n".join(sorted(map(str, rows))).encode()).hexdigest()
    assert digest(tuple(r[c] for c in cols) for r in got.collect()) == digest(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
