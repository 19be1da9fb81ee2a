import numpy as np

from weft.llm import binary_codes
from weft.llm.binary_codes import bounds, decode, encode, near_duplicates
from weft.llm.cross_polytope import best_of_cell, hadamard, meeting, nearest, tables_of

ROWS = "vec_id long, embedding array<float>, id long"


def vectors(seed, n, d=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(n // 2)] + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.2, 0.4])
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], ROWS)


def cosines(x):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_near_duplicates_against_brute_force(spark):
    x = vectors(1, 500)
    true = cosines(x) >= 0.9
    links = true.sum(axis=1) - 1
    got = sorted(near_duplicates(frame(spark, x)).collect())
    found = np.array([r["n_links"] for r in got])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        assert r["component_id"] <= r["vec_id"]


def test_near_duplicates_miss_nothing(spark):
    x = vectors(6, 2600)
    true = cosines(x) >= 0.9
    links = true.sum(axis=1) - 1
    for bits in (None, 12):
        got = sorted(near_duplicates(frame(spark, x), bits=bits).collect())
        assert [r["n_links"] for r in got] == links.tolist()


def test_pairs_meet_at_any_number_of_bits():
    rng = np.random.default_rng(7)
    x, y = np.linalg.qr(rng.standard_normal((4000, 64, 2)))[0].transpose(2, 0, 1)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    for n in (100_000, 1_000_000, 10_000_000, 100_000_000):
        bits = binary_codes.bits_for(n)
        tables = binary_codes.tables_for(bits, 0.9)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= binary_codes.MISS
        meets = binary_codes.table_keys(x, tables, bits) == binary_codes.table_keys(y, tables, bits)
        assert meets.any(axis=1).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    for d in (3, 64, 200):
        x = rng.standard_normal((400, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[200:] = 0.92 * x[:200] + np.sqrt(1 - 0.92**2) * (x[200:] - (x[200:] * x[:200]).sum(axis=1, keepdims=True) * x[:200]) / np.linalg.norm(x[200:] - (x[200:] * x[:200]).sum(axis=1, keepdims=True) * x[:200], axis=1, keepdims=True)
        code = encode(x, np.arange(400))
        o, q, f, step = decode(code)
        assert code.shape[1] == max(128, d) // 2 + 8 and (f > 0).all()
        true, error = x @ x.T, o @ q.T - x @ x.T
        assert abs(error[~np.eye(400, dtype=bool)].mean()) < 0.004
        near = (true >= 0.9) & ~np.eye(400, dtype=bool)
        least = bounds(f, step, o.shape[1], 0.9)
        assert near.sum() >= 400 and ((o @ q.T) >= least[:, None])[near].all()
        # The codes do rule out pairs: few of those far below the threshold are left.
        assert d < 64 or ((o @ q.T) >= least[:, None])[true < 0.4].mean() < 1e-3


def test_vector_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.0, 3.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [float("inf"), 1.0], 1), (50, [1.0, 0.1], 1)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got[0] == (3, 0, True) and got[1] == got[7] == (3, 0, False) and got[50] == (3, 0, False)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 8)) and got[None] == (0, None, False)
    near = [tuple(r) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in near] == [(0, 1, 1), (0, 2, 7), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 7)]
    assert near[0][3] == 1.0
    assert near_duplicates(df.limit(0)).count() == 0 and nearest(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).standard_normal((5, 16))
    assert np.allclose(hadamard(hadamard(x)), x)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_recall_of_nearest(spark):
    x = np.random.default_rng(4).standard_normal((3000, 64)).astype(np.float32)
    c = cosines(x)
    np.fill_diagonal(c, -2)
    got = {}
    for r in nearest(frame(spark, x)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - c[q, v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.argsort(-c[q])[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(32)
    near = [(base + rng.standard_normal(32) * e).tolist() for e in (0.01, 0.02, 0.03, 0.04, 0.05)]
    rows = [(0, base.tolist(), 0)] + [(1, (base * (1 + n)).tolist(), 0) for n in range(40)] + [(i + 2, v, 0) for i, v in enumerate(near)]
    got = [(r["rank"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, ROWS)).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def brute(rows, k=5, every=50):
    best = {}
    for q, v, _ in rows:
        if q is None or q % every or not v:
            continue
        for c, w, _ in rows:
            if c is not None and c != q and w and len(w) == len(v):
                cos = float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)))
                best[q, c] = max(best.get((q, c), -2), round(cos, 9))
    out = []
    for q in sorted({q for q, _ in best}):
        found = sorted((-s, c) for (x, c), s in best.items() if x == q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return out


def test_all_candidates_if_few(spark):
    """0 to 7 candidates, opposite vectors, equal rows, ties and other lengths: always k or all of them."""
    rng = np.random.default_rng(9)
    for n in range(8):
        rows = [(50 + i, rng.standard_normal(16).astype(np.float32).tolist(), 0) for i in range(n + 1)]
        got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(spark.createDataFrame(rows, ROWS)).orderBy("query_id", "rank").collect()]
        assert got == brute(rows)
    v = rng.standard_normal(8).astype(np.float32)
    for rows in (
        [(0, v.tolist(), 0), (1, (-v).tolist(), 0)],
        [(50, v.tolist(), 0)] + [(51, (v + 1).tolist(), 0)] * 8 + [(60 + i, (v + rng.standard_normal(8).astype(np.float32)).tolist(), 0) for i in range(6)],
        [(i, [1.0, float(i % 3)], 0) for i in range(60)] + [(100, [1.0, 0.0, 0.0], 0), (150, [0.5, 0.0, 0.0], 0), (200, [2.0], 0)],
    ):
        got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(spark.createDataFrame(rows, ROWS)).orderBy("query_id", "rank").collect()]
        assert got == brute(rows)


def test_hot_vector_in_one_cell():
    x = np.random.default_rng(10).standard_normal((6, 8))
    items = np.r_[np.repeat(x[:1], 5000, axis=0), 2 * np.repeat(x[:1], 300, axis=0), x[1:]]
    ids = np.random.default_rng(11).permutation(len(items))
    got = [(q, c) for a, b, s in best_of_cell(np.array([7]), x[:1], ids, items, 5) for q, c in zip(a.tolist(), b.tolist(), strict=True)]
    assert got == [(7, c) for c in sorted(i for i in ids[:5300].tolist() if i != 7)[:5]]


def test_probing_widens_by_measured_chances():
    """What the chances say about pairs at a cosine holds for other pairs, with one and with two axes a key."""
    rng = np.random.default_rng(12)
    for second in (0, 4):
        made = tables_of(64, 4, second, 5)
        for at, probes in ((8, 24), (12, 4), (16, 4)):
            c = at / 20
            x, y = np.linalg.qr(rng.standard_normal((1500, 64, 2)))[0].transpose(2, 0, 1)
            y = c * x + np.sqrt(1 - c * c) * y
            share = (made.nearest(x, probes) == made.nearest(y, 1)).any(axis=(1, 2)).mean()
            assert abs(share - meeting(64, 4, second, 5, probes)[at]) < 0.06
        assert len({tuple(b) for b in made.nearest(x[:1], 24)[0, :1].T.tolist()}) == 24


def test_nearest_with_two_axes_a_key(spark, monkeypatch):
    """Near neighbours are found by probes of two-axis keys; the far ones by every bucket."""
    from weft.llm import cross_polytope

    monkeypatch.setattr(cross_polytope, "PER_BUCKET", 4)
    x = vectors(13, 2000, 64)
    c = cosines(x)
    np.fill_diagonal(c, -2)
    got = {}
    for r in nearest(frame(spark, x)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set(np.argsort(-c[q], kind="stable")[:5].tolist())) for q in got)
    assert len(got) == 40 and hits >= 0.9 * 200
