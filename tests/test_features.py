"""Message features and method scores against plain versions."""

import math
import random
import re
from collections import Counter

from weft.functions.features import FEATURES, SCALES, WEIGHTS, default_weights, message_features, method_scores


def plain_features(t):
    n, words = len(t), t.split()
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(t).values())
    numbers, special = any(c.isdigit() for c in t), any(not c.isalnum() and not c.isspace() for c in t)
    average = sum(map(len, words)) / len(words) if words else 0
    pattern = 0.3 * (" " in t) + 0.4 * (numbers and special) + 0.2 * (n > 100) + 0.3 * (entropy < 4)
    template = pattern + 0.2 * (len(words) > 5) + 0.1 * (average > 6)
    structured, repeats, looks = 0.5 * (numbers and special), 0.0, False
    if n > 50:
        found = {t[i : i + k] for k in range(4, min(21, n // 2 + 1)) for i in range(n - 2 * k + 1) if t.count(t[i : i + k]) > 1}
        repeats = min(1.0, len(found) / 5)
        share = lambda marks: sum(m in t for m in marks) / len(marks)
        commas = [x.count(",") for x in t.split("\n")[:5] if x.strip()]
        csv = 0.8 if "," in t and "\n" in t and len(set(commas)) == 1 and commas[0] > 0 else 0
        looks = share('{}[]":,') * 0.4 + share('<>/="') * 0.3 + 0.2 * (0.5 * bool(re.search(r"\w+\s*=\s*\w+", t)) + 0.5 * bool(re.search(r"\w+\s*:\s*\w+", t))) + csv * 0.1 > 0.3
        structured += 0.4 * looks
    clamp = lambda x: max(0.0, min(1.0, x))
    return {
        "length": n, "entropy": entropy, "has_numbers": numbers, "has_special_chars": special, "word_count": len(words), "compression_potential": clamp(1 - entropy / 8), "pattern_score": min(1, pattern),
        "fast_path_potential": clamp(0.4 * (numbers and special) + 0.3 * (pattern > 0.5) + 0.2 * (n < 500) - 0.2 * (entropy > 6)), "metadata_size_estimate": 100 + 50 * numbers + 30 * special + min(n // 10, 200),
        "template_match_score": min(1, template), "pattern_semantic_score": min(1, 0.6 * pattern), "semantic_chunks": max(1, len(words) // 6), "ai_patterns_found": len(words) // 12, "semantic_complexity": 0.5,
        "binary_semantic_potential": clamp(min(1, 0.6 * looks + 0.3 * structured + 0.4 * repeats + 0.3 * template)), "structured_data_score": clamp(structured), "repetitive_pattern_score": repeats, "avg_word_length": average,
    }


def test_features_and_scores(spark):
    rng = random.Random(1)
    texts = ["", "a", "ok then", '{"key": "value", "list": [1, 2, 3], "more": "text that goes on for long"}', "abcabcabc" * 9, "a,b,c\n1,2,3\n4,5,6\n" * 4, "é ß 漢 " * 30, "mode = fast: yes" + "x" * 60]
    texts += ["".join(rng.choice("abcdef 0123.,:;\n") for _ in range(rng.randint(1, 160))) for _ in range(40)]
    texts += [" ".join(rng.choice(["status", "session", "42", "ready!", "ok"]) for _ in range(rng.randint(1, 90))) for _ in range(10)]
    f = message_features(spark.createDataFrame([*enumerate(texts), (999, None)], "k int, t string"), ["k"], "t")
    got = {r["k"]: r.asDict() for r in f.collect()}
    for k, t in enumerate(texts):
        want = plain_features(t)
        for c, v in want.items():
            assert abs(got[k][c] - v) < 1e-9, (t, c, got[k][c], v)
    assert {c: got[999][c] for c in FEATURES} == {c: got[0][c] for c in FEATURES} and len(got) == len(texts) + 1
    stats = spark.createDataFrame([("layered", 2.5, 2.0), ("runs", 1.3, 0.0)], "method string, avg_ratio double, avg_time double")
    for r in method_scores(f, ["k"], default_weights(spark), stats).where("k < 20").collect():
        match = sum(w * got[r["k"]][c] / SCALES.get(c, 1) for c, w in zip(FEATURES, WEIGHTS[r["method"]], strict=True))
        past = {"layered": 2.5 * 0.7 + 0.3 / 2, "runs": 1.3 * 0.7 + 0.3 / 0.001}.get(r["method"], 0)
        assert abs(r["feature_match"] - match) < 1e-9 and abs(r["score"] - 0.6 * match - 0.4 * past) < 1e-9
