import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import zstandard
from pyspark.sql import functions as F

from tests.llm.written_pages import PAGES as WRITTEN
from weft.llm import html as pages
from weft.llm.chat import conversations, link_quotes
from weft.llm.mixing import mix, with_source
from weft.llm.packing import optimal_bounds, pack
from weft.llm.quality import BLOCK, DICTIONARY, LEVEL, PRIOR, dictionary_of, fit, quality
from weft.llm.queries import OP10_SQL
from weft.llm.sharding import SPARE_BITS, shard, write_shards

DOCS = "doc_id long, text string, source string, rank long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def padding(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        best = min(padding(lengths, counts, c) for m in range(1, k + 1) for c in itertools.combinations(lengths, m) if c[-1] == lengths[-1])
        bounds = optimal_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert padding(lengths, counts, bounds) == best


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.choice([1, 5, 90, 700, 3000])), None, i) for i in range(300)] + [(900, None, "s", 1), (901, "", "s", 1), (None, "a b", "s", 1), (5, "a", "s", 2)]
    got = pack(spark.createDataFrame(rows, DOCS), budget=2000, buckets=4).collect()
    assert len(got) == len(rows)
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["padded_length"]
        batches[r["batch_id"]].append(r)
    for b in batches.values():
        assert len({r["bucket"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["padded_length"] <= 2000
    assert sum(len({x for x, b in batches.items() if b[0]["bucket"] == k and len(b) < max(1, 2000 // max(1, b[0]["padded_length"]))}) > 1 for k in range(4)) == 0
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_padding_is_least_over_all_lengths(spark):
    """The padding of a packed corpus is the optimum of a plain programme over every length, long ones too."""
    rng = random.Random(9)
    lengths = [rng.choice([3, 50, 1025, 1030, 1500, 2047, 2100, 4099, 9000]) + rng.randrange(9) for _ in range(120)] + [0, 20_011]
    df = spark.createDataFrame([(i, "w " * n, "s", 0) for i, n in enumerate(lengths)], DOCS)
    got = pack(df, buckets=6).collect()
    kinds = sorted(set(lengths))
    count, best = Counter(lengths), {(-1, 0): 0}
    for k in range(1, 7):
        for j in range(len(kinds)):
            options = [best[i, k - 1] + sum(count[n] * (kinds[j] - n) for n in kinds[i + 1 : j + 1]) for i in range(-1, j) if (i, k - 1) in best]
            if options:
                best[j, k] = min(options)
    assert sum(r["padded_length"] - r["n_tokens"] for r in got) == min(best[len(kinds) - 1, k] for k in range(1, 7) if (len(kinds) - 1, k) in best)
    assert sorted(r["n_tokens"] for r in got) == sorted(lengths)


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left, open_ = {}, sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]} if total else set()
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
        open_ -= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.choice([0, 3, 40, 200])) or rng.choice([None, "", " "]), rng.choice(["a"] * 60 + ["b"] * 30 + ["c", "d", None]), i) for i in range(900)]
    rows += [(2000, "", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60, (s, taken[s], t)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df.repartition(7)).collect()), key=str)
    assert mix(df.limit(0)).count() == 0


def test_mixing_ranks_by_odds(spark):
    """Against a plain version: sampled ranks are u's odds over inclusion odds, not u, and longer texts are likelier."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.choice([1, 4, 30, 300])), rng.choice("aab"), i) for i in range(1500)] + [(None, "w w", "a", 0)] * 3 + [(3, "w " * 9, "a", 1)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    goal, want, orders_differ, odds = targets(dict(sizes)), Counter(), False, {}
    for s in sizes:
        docs = [(str(i) if i is not None else "null", len(t.split())) for i, t, x, _ in rows if x == s]
        weight, full = {n: n.bit_length() for _, n in docs}, set()
        while True:
            rest = sum(n * weight[n] for _, n in docs if weight[n] not in full)
            level = (goal[s] - 3 * sum(n for _, n in docs if weight[n] in full)) / rest if rest else 0
            over = {weight[n] for _, n in docs if weight[n] not in full and level * weight[n] > 3}
            if not over:
                break
            full |= {max(over)}
        r = {n: 3.0 if weight[n] in full else level * weight[n] for _, n in docs}
        missing = goal[s] - sum(int(r[n]) * n for _, n in docs)
        ranked = []
        for name, n in docs:
            p, u = r[n] - int(r[n]), (int(hashlib.md5(f"mix{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if p > 0:
                ranked.append(((u / (1 - u)) / (p / (1 - p)), name, n, u))
        ranked.sort()
        orders_differ |= ranked != sorted(ranked, key=lambda x: (x[3], x[1], x[2]))
        odds[s] = {n: r[n] - int(r[n]) for n in r}
        upto, picked = 0, {}
        for key, tied in itertools.groupby(ranked):
            tied = list(tied)
            upto += sum(x[2] for x in tied)
            picked[key] = 2 * upto - key[2] <= 2 * missing
        gap = missing - sum(x[2] for x in ranked if picked[x])
        could = [(abs(gap - (-x[2] if picked[x] else x[2])), x) for x in ranked if x[2]]
        could = [x for x in could if x[0] < abs(gap) - 1e-9]
        flip = min(could)[1] if could else None
        for name, n in docs:
            one = next((x for x in ranked if x[1:3] == (name, n)), None)
            want[s, name, n, int(r[n]) + (one is not None and picked[one] != (one == flip))] += 1
    assert orders_differ and any(len({round(p, 3) for p in of.values()}) > 1 for of in odds.values())
    assert Counter((r["source"], "null" if r["doc_id"] is None else str(r["doc_id"]), r["size"], r["copies"]) for r in got) == want


def test_sharding(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 900), "s", 0) for i in range(800)] + [(7, "y" * 400, "t", 1)] * 30 + [(900, "z" * 5000, "s", 0), (None, None, None, 0), (901, None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = shard(df, limit=4096).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["prefix"], r["part"]].append(r)
    prefixes = {p for p, _ in by}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    for rs in by.values():
        assert sum(r["n_bytes"] for r in rs) == rs[0]["shard_bytes"]
        assert rs[0]["shard_bytes"] <= 4096 or len(rs) == 1
    assert shard(df.limit(0)).count() == 0
    write_shards(df.where("doc_id > 900 OR doc_id < 5"), str(tmp_path / "s"), limit=4096)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6


def test_sharding_splits_on_every_bit(spark):
    """Buckets of equal leading bits split further down; equal ids, which nothing splits, become parts."""
    rng = random.Random(4)
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(60_000)}
    close = sorted(h, key=h.get)
    near = max(range(len(close) - 1), key=lambda k: (h[close[k]] ^ h[close[k + 1]]).bit_length() * -1)
    ids = [close[near], close[near + 1], *rng.sample(range(60_000), 40)] + [17] * 25
    rows = [(i, "x" * 700, "s", 0) for i in ids]
    got = shard(spark.createDataFrame(rows, DOCS), limit=1000).collect()
    deep = 60 - (h[close[near]] ^ h[close[near + 1]]).bit_length() + 1
    by = {r["doc_id"]: r for r in got}
    assert by[close[near]]["depth"] == by[close[near + 1]]["depth"] == deep > (len(rows) * 700 // 1000).bit_length() + SPARE_BITS
    assert all(r["shard_bytes"] <= 1000 for r in got)
    assert sorted(r["part"] for r in got if r["doc_id"] == 17) == list(range(-25, 0))
    assert all(r["part"] == 0 for r in got if r["doc_id"] != 17)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 900), "s", 0) for i in range(100)] + [(7, "y" * 400, "t", i) for i in range(30)] + [(None, "z" * 300, "n", i) for i in range(20)] + [(None, None, None, 0)]
    write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "s"), limit=4096)
    got = spark.read.option("inferSchema", False).parquet(str(tmp_path / "s")).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["rank"]) for r in got) == Counter(rows)
    size = Counter()
    for r in got:
        size[str(r["shard"])] += len(r["text"] or "")
    assert max(size.values()) <= 4096 and len({r["shard"] for r in got if r["doc_id"] == 7}) > 1


def junk(rng, good):
    ws = ["".join(rng.choice(["an", "ther", "ing", "o", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 120))]
    return " ".join(ws) + "." if good else " ".join(w.upper() + "!!" for w in ws)


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, junk(rng, i % 6 != 0), "s", i) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(900)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*rows, (1000, None, "s", 0), (1001, "", "s", 0), (None, "the end", "s", 0)], DOCS)
    got = quality(df, labels).collect()
    assert len(got) == 903
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 6 != 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality(df.limit(0), labels.limit(0)).count() == 0
    assert {round(r["score"], 6) for r in quality(df, labels.where("quality = 1")).collect()} != {0.0}


def test_quality_against_brute_force(spark):
    """Scores are the calibrated difference of two compressed sizes, block by block over the whole text, and nothing else."""
    rng = random.Random(6)
    rows = [(i, junk(rng, i % 3 != 0) * (40 if i % 50 == 0 else 1), "s", i) for i in range(300)] + [(400, None, "s", 0), (401, "", "t", 0)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    model = fit(df, labels)
    assert model == fit(df.repartition(5), labels.repartition(3))
    made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.bad, model.good)]
    for r in quality(df, labels).collect():
        b = (rows[r["doc_id"]][1] if r["doc_id"] < 300 else "" or "").encode()
        size = [sum(len(c.compress(b[p : p + BLOCK])) for p in range(0, len(b), BLOCK)) for c in made]
        z = model.intercept + model.slope * max(model.least, (size[0] - size[1] + PRIOR * model.average) / (len(b) + PRIOR))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_dictionaries_are_trained_on_whole_texts():
    rng = random.Random(5)
    texts = [("x" * 3000 + f" the tail number {i % 3} of every text " + "".join(rng.choice("abcdefgh ") for _ in range(60))).encode() for i in range(500)]
    d = dictionary_of(texts)
    assert len(d) <= DICTIONARY and all(f"tail number {k} of every".encode() in d for k in range(3))
    assert dictionary_of([b"only one"]) == b"only one" and dictionary_of([]) == b""


PAGES = "page_id long, url string, html string, text string"


def test_html_blocks():
    p = "<html><head><title>T</title></head><body><nav><a href='a>b'>Home</a></nav><p>One &amp; <b>two<br>three<p>Fo&#117;r < 5</p><script>x('<p>no')</script><!-- <p>no --><ul><li>a<li>b</ul>"
    assert [(path, text) for path, text, _ in pages.blocks(p)] == [("nav", "Home"), ("p", "One & two three"), ("p", "Four < 5"), ("ul li", "a"), ("ul li", "b")]
    assert pages.blocks("") == [] and pages.blocks("plain") == [("", "plain", 0)]


def test_html_held_out_pages():
    rng, right, total = np.random.default_rng(77), 0, 0
    for _ in range(200):
        page, labels = pages.training_page(rng)
        b = pages.blocks(page)
        assert len(b) == len(labels)
        x, mask = pages.padded(pages.vectors([b]), [len(b)])
        right += int(((pages.trained().logits(x, mask)[:, 0] > 0) == np.array(labels)).sum())
        total += len(b)
    assert right >= 0.98 * total


def test_written_pages():
    """Blocks of pages written by hand, outside the grammar."""
    right = extra = missing = 0
    for page, want in WRITTEN:
        got = Counter(x for x in pages.main_blocks([pages.blocks(page)], pages.trained())[0].split("\n") if x)
        right += sum((got & Counter(want)).values())
        extra += sum((got - Counter(want)).values())
        missing += sum((Counter(want) - got).values())
    assert 2 * right / (2 * right + extra + missing) >= 0.93


def test_malformed_pages_take_linear_time():
    began = time.time()
    for page in ("<a " * 400_000, "<a '>' " * 100_000, "<!" * 300_000, '<a "' * 200_001, "<" * 500_000, "<script>" * 100_000, "<div>" * 100_000 + "x" + "</p>" * 100_000 + "</div>" * 100_000):
        pages.blocks(page)
    assert time.time() - began < 20
    deep = pages.blocks("<div class=a>" * 20_000 + "x")
    assert len(deep) == 1 and deep[0][0].count(" ") == pages.DEPTH - 1
    assert [b[1] for b in pages.blocks("<p>a <b title=\"x>y\">b</b></p><p title='>c</p><p>d")] == ["a b", "c", "d"]
    assert [b[1] for b in pages.blocks("<p hidden>a</p><div style='color:red;display : none'>b<p>c</div>d<p class=hidden>e <i hidden>f<i>g</i>h</i> i")] == ["d", "e i"]


def test_long_pages_are_labelled_in_pieces():
    rng, page = np.random.default_rng(6), []
    while len(page) < 700:
        page += pages.blocks(pages.training_page(rng)[0])
    x, mask = pages.padded(pages.vectors([page]), [len(page)])
    whole = pages.trained().logits(x, mask)[:, 0]
    assert np.allclose(pages.trained().long_logits(page, 64), whole, atol=1e-3)
    long = "<body>" + "<p>A paragraph of some words, and then a few more of them.</p>" * (pages.LONG + 10)
    assert pages.main_blocks([pages.blocks(long), []], pages.trained())[1] == ""


def test_html_gradients():
    rng = np.random.default_rng(5)
    net, x = pages.Labeller(6, 1), rng.standard_normal((4, 3, 6))
    mask, y = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float), rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        z = net.logits(x, mask)
        return float((mask * (np.log1p(np.exp(z)) - y * z)).sum() / mask.sum())

    g = net.gradients(x, mask, y)
    for k in net.w:
        at = tuple(int(rng.integers(s)) for s in net.w[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-5
        up = loss()
        net.w[k][at] = old - 1e-5
        down = loss()
        net.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_html_cases(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A  title</h1><p>Some text\nof it.</p></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", None), (1, "u", page, "t")], PAGES)
    got = sorted((tuple(r) for r in pages.extract(df).collect()), key=str)
    want = "A title\nSome text of it."
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert pages.extract(df.limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello  there\n\nSecond paragraph of mine"), (1, 1, "assistant", "> hello there\nHi!"), (1, 2, "user", "Unrelated"),
        (1, 3, "assistant", ">> Hello there\n> Hi!\nDeep reply\n"), (1, 4, "user", "> SECOND paragraph\n> of mine\nhm"), (1, 5, "user", "> second paragraph of mine\nok"),
        (1, 6, "user", "> never said\nwhat"), (2, 0, "user", "> Hello there\nother conversation"), (None, 0, "user", "> Hello there"), (2, 1, "user", None), (1, 5, "user", "> second paragraph of mine\nok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert [by[1, t]["reply_to"] for t in range(7)] == [None, 0, None, 1, 0, 0, None]
    assert [by[1, t]["thread_root"] for t in range(7)] == [0, 0, 2, 0, 0, 0, 6]
    assert by[1, 3]["text"] == "Deep reply" and by[1, 3]["n_quoted"] == 2 and by[1, 0]["text"].startswith("Hello  there")
    assert by[2, 0]["reply_to"] is None and by[2, 0]["text"] == "other conversation" and by[2, 1]["text"] == "" and by[None, 0]["text"] == ""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = duck.execute(f"SELECT conv_id, turn, role, text, n_quoted, reply_to, thread_root, position FROM ({OP10_SQL})").fetchall()
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in got)
    order = [m["turn"] for m in conversations(df).where("conv_id = 1").collect()[0]["messages"]]
    assert order == [0, 1, 3, 4, 5, 5, 2, 6]
    assert link_quotes(df.limit(0)).count() == 0


def plain_links(rows):
    """A plain version of quotation linking: own text, quoted lines, answered turn, root and position."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    mark = re.compile(r"^\s*(>[\s>]*)")
    own, quoted = {}, {}
    for c, t, _, text in rows:
        lines, passages, held = (text or "").split("\n"), [], None
        plain = [x for x in lines if not mark.match(x)]
        for x in [*lines, ""]:
            m = mark.match(x)
            level = m[1].count(">") if m else 0
            if held and held[0] != level:
                passages.append(held)
                held = None
            if level:
                held = (level, [*(held[1] if held else []), mark.sub("", x)])
        own[c, t] = re.sub(r"^\n+|\n+\Z", "", "\n".join(plain)) if len(plain) < len(lines) else (text or "")
        quoted[c, t] = (passages, len(lines) - len(plain))
    said = defaultdict(dict)
    for (c, t), text in sorted(own.items()):
        for unit in [text, *re.split(r"\n\s*\n", text), *text.split("\n")]:
            if norm(unit):
                said[c].setdefault(norm(unit), t)
    up, out = {}, {}
    for (c, t), (passages, _) in quoted.items():
        found = [(level, kind, -said[c][norm(u)]) for level, body in passages for kind, units in ((0, ["\n".join(body)]), (1, body)) for u in units if said[c].get(norm(u), t) < t]
        if found:
            up[c, t] = -min(found)[2]
    root = lambda c, t: root(c, up[c, t]) if (c, t) in up else t
    order = defaultdict(list)
    for c, t in own:
        order[c].append((root(c, t), t))
    for c, t in own:
        out[c, t] = (own[c, t], quoted[c, t][1], up.get((c, t)), root(c, t), 1 + sum(x < (root(c, t), t) for x in order[c]))
    return out


def test_nested_quotes_against_a_plain_version(spark):
    rng, rows = random.Random(12), []
    for c in range(60):
        said = []
        for t in range(rng.randint(1, 60)):
            text = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                if said:
                    depth, old = rng.randint(1, 3), rng.choice(said).split("\n")
                    at = rng.randrange(len(old))
                    marks = rng.choice([">" * depth + " ", "> " * depth, " >" * depth])
                    text += [marks + x for x in (old if rng.random() < 0.5 else old[at : at + 1])]
                    text += [rng.choice(["", "Yes.", "No  way"])] * rng.randint(0, 1)
            body = "\n".join(rng.choice(["Alpha", "beta", "GAMMA delta", "so, what?", "", f"line {rng.randrange(400)}"]) for _ in range(rng.randint(1, 5)))
            said.append(body)
            rows.append((c, t, "user", "\n".join([*text, body])))
    want = plain_links(rows)
    assert sum(w[2] is not None for w in want.values()) > 300 and max(w[1] for w in want.values()) > 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("reply", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): (r["text"], r["n_quoted"], r["reply_to"], r["thread_root"], r["position"]) for r in link_quotes(df).collect()}
    assert got == want


def test_very_long_messages(spark):
    """A message of 40,000 lines whose levels alternate is read in linear time."""
    long = "\n".join(f"> line {k}" if k % 2 else f"answer {k}" for k in range(40_000))
    rows = [(1, 0, "u", "\n".join(f"line {k}" for k in range(40_000))), (1, 1, "a", long)]
    got = {r["turn"]: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["reply_to"] == 0 and got[1]["n_quoted"] == 20_000 and got[1]["position"] == 2


def test_source_joins_agree(spark):
    """Shipped and salted joins give the same rows."""
    rows = spark.createDataFrame([(k % 7 or None, f"s{k % 3}") for k in range(50)], "doc_id long, key string")
    of = spark.createDataFrame([("s0", 1.0), ("s1", 2.0)], "key string, x double")
    for how in ("inner", "left"):
        a, b = (sorted(map(repr, with_source(rows, of, how, n).select("doc_id", "key", "x").collect())) for n in (1 << 20, 0))
        assert a == b and len(a) == (34 if how == "inner" else 50)
