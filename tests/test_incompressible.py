"""The whole predicate against plain Python."""

import math
from collections import Counter

from pyspark.sql import functions as F

from weft.functions.text import TOKENS, incompressible


def plain(t):
    if not t:
        return True
    n, low = len(t), t.lower()
    token = low.strip(" .,;:-_") in TOKENS
    if n <= 3:
        return not (n > 1 and len(set(t)) == 1 or token)
    sample = t if n <= 1000 else t[:333] + t[n // 2 - 166 : n // 2 + 166] + t[-333:]
    counts = Counter(sample).values()
    entropy = -sum(c / len(sample) * math.log2(c / len(sample)) for c in counts)
    if n < 10:
        unit = any(len(low) % u == 0 and low == low[:u] * (len(low) // u) for u in range(1, len(low) // 2 + 1))
        return not (max(counts) / n >= 0.7 or unit or token or entropy <= 2.5)
    return entropy > 7.0


def test_incompressible(spark):
    wide = "".join(chr(0x4E00 + i) for i in range(300))
    texts = [None, "", "a", "aa", "aab", "OK", "no.", "xyz", "aaa", "aaaa", "abcd", "abAB", "abcabc", "error", "Ready!", "-status-", "aabbcdef", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaabc", "aaaaaabcd", "a b c d e"]
    texts += ["abcdefghij", wide, wide[:128], wide[:129], wide * 5, "a" * 1200 + wide + "b" * 1200, wide + "a" * 3000, "plain words of a message " * 60, "e\u0301\U0001F600xyz", "\U0001F600\U0001F600", "\n\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", incompressible(F.col("t")).alias("x")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, plain(t)) for t in texts]
    assert {plain(t) for t in texts if t and 4 <= len(t) < 10} == {plain(t) for t in texts if t and len(t) >= 10} == {True, False}
