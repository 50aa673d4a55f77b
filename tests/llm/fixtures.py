"""Small tables with the awkward cases: nulls, empties, long texts, ties, repeats, clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, key string, task int"
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds watch from an old oak near the river".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + ("" if x % 5 else chr(97 + x // 7 % 26)))
    return " ".join(out)


def documents(spark):
    texts = [(1, prose(1, 80)), (2, prose(2, 200)), (3, prose(1, 80)), (4, None), (5, ""), (6, "one"), (7, " \t\n "), (None, prose(3, 90)), (2, prose(2, 200)), (8, prose(4, 30_000)), (9, "ÄÖ naïve \u00a0 Ünï\u2028x " + prose(5, 60)), (10, "a b c a b c a b c " * 20), (11, "x" * 300_000)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", None, 5, "clash", None, 1) for i, t in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
