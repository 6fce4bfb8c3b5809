"""Chats, URLs and vectors against brute force."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, topk, url_filter


def test_op3_against_sql(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rng = random.Random(2)
    turns = []
    for c in range(60):
        base = c % 7
        for t in range(rng.randint(1, 6)):
            turns.append((c, t, rng.choice(["user"]) if t % 2 == 0 else "assistant", f"base {base} turn {t}" if rng.random() < 0.97 else "other <|im_end|>", "x"))
    turns += [turns[0], (None, 0, "user", "a", "x"), (70, None, None, None, "x"), (71, 0, "user", "", "x"), (72, 0, "user", None, "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, h0 string")
    got = sorted(map(tuple, chat.collapse(rows).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [t[:4] for t in turns])
    assert got == sorted(con.execute(chat.SQL).fetchall())
    assert chat.collapse(rows.limit(0)).count() == 0


def test_op8_rules_and_models(spark):
    rng = random.Random(4)
    rows = [(i, f"https://{rng.choice(['www.', '', 'a.'])}example.com{rng.choice(['/en/', '/x/'])}{i}?q#f") for i in range(200)]
    rows += [(1000 + i, f"http://bad{i}.net/es/cheap-pills-{i}") for i in range(150)]
    rows += [(2000, None), (2001, "no scheme"), (None, "http://EXAMPLE.com"), (2002, "http://x.org/es/cheap-pills-7"), (2003, "https://www.example.org/x/7?q#f"), (2004, "http://notcom/"), (2005, "http://a.com?x/y"), (2006, "https://h.net/fr/"), (2007, "://com/")]
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in rows], "page_id long, url string, html string, score string").repartition(3)
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    urls = dict(rows)
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0])
        assert r["verdict"] in ("allow", "block") and (best[1] is None or r["verdict"] == best[1])
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[2002] == "block" and verdict[2003] == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_op8_scores_by_brute_force(spark, monkeypatch):
    """Exact counts of every context, whatever the groups, and the threshold of the held-out URLs."""
    monkeypatch.setattr(url_filter, "GROUP", 7)
    rng = random.Random(8)
    good, bad = [f"http://a.com/{rng.choice(['news', 'home'])}/{rng.randint(0, 99)}" for _ in range(90)], [f"http://b.net/es/{rng.choice(['buy', 'win'])}-{rng.randint(0, 99)}" for _ in range(60)]
    free = ["http://x.org/news/1", "http://x.org/es/buy-1", "", "http://ü.org/", "http://x.org/news/1"]
    pages = spark.createDataFrame(list(enumerate(good + bad + free)), "page_id long, url string").repartition(5)
    held = {r["url"] for r in pages.where("pmod(xxhash64(cast(url as binary)), 8) = 0").collect()}

    def counts(urls):
        c = Counter()
        for u in urls:
            b = b"\x02" * 5 + u.encode() + b"\x03"
            for i in range(5, len(b)):
                for n in range(6):
                    c[n, b[i - n : i]] += 1
                    c[n, b[i - n : i], b[i]] += 1
        return c

    def score(u, models):
        b, total = b"\x02" * 5 + u.encode() + b"\x03", 0.0
        for i in range(5, len(b)):
            for sign, c in zip((1, -1), models, strict=True):
                p = 1 / 256
                for n in range(6):
                    p = (c[n, b[i - n : i], b[i]] + 2 * p) / (c[n, b[i - n : i]] + 2)
                total += sign * math.log(p)
        return total / (len(b) - 5)

    seen = [counts([u for u in x if u not in held]) for x in (good, bad)]
    tried = [(score(u, seen), u in good) for u in good + bad if u in held]
    cuts = [(sum(s >= c / 100 for s, k in tried if k) / sum(k for _, k in tried) + sum(s < c / 100 for s, k in tried if not k) / sum(not k for _, k in tried), c) for c in range(-1000, 1001)]
    best = [c for right, c in cuts if right >= max(cuts)[0] - 1e-12]
    cut, models = best[len(best) // 2] / 100, [counts(good), counts(bad)]
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(free, 150):
        assert got[i]["score"] == pytest.approx(score(u, models)) and got[i]["verdict"] == ("allow" if score(u, models) >= cut else "block")
    assert all(got[i]["verdict"] == ("allow" if i < 90 else "block") and got[i]["score"] is None for i in range(150))


def _vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 70))
    vectors = [(i, [float(x) for x in base[i % 12] + rng.normal(size=70) * (0 if i % 50 < 5 else 0.4)], 1) for i in range(500)]
    vectors += [(i, [float(x) for x in rng.normal(size=70)], 1) for i in range(500, 700)]
    return vectors


def _nearest_by_brute_force(bits):
    want = set()
    ids = np.arange(len(bits))
    for q in range(0, len(bits), 20):
        d = (bits != bits[q]).sum(axis=1)
        for rank, i in enumerate([i for i in np.lexsort((ids, d)) if i != q][:10], 1):
            want.add((q, rank, int(i), int(d[i])))
    return want


@pytest.mark.parametrize("cell", [1 << 14, 40, 8])
def test_op10_brute(spark, monkeypatch, cell):
    """One cell a segment, several, and hot cells that are dealt to pieces."""
    monkeypatch.setattr(topk, "CELL", cell)
    vectors = _vectors()
    # Without an id, without components, and rows that repeat an id.
    extra = [(None, vectors[0][1], 1), (900, None, 1), (901, [], 1), vectors[40], vectors[41]]
    df = spark.createDataFrame(vectors + extra, "vec_id long, embedding array<float>, distance int").repartition(4)
    bits = np.array([[x > 0 for x in v] for _, v, _ in vectors])
    assert set(map(tuple, topk.search(df).collect())) == _nearest_by_brute_force(bits)
    assert topk.search(df.limit(0)).count() == 0


def test_op10_every_query_is_settled_by_its_radius(spark):
    vectors = _vectors()
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, distance int")
    layout = topk.Layout(len(vectors), 70)
    codes = topk.coded(df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), 70)
    got = topk.nearest(codes, codes.where("vec_id % 20 = 0"), layout, 11).collect()
    assert all(len(r["near"]) == 11 and r["near"][10]["d"] <= r["covered"] for r in got)
    # Near copies are settled by small radii, the others by larger ones, few by reading all.
    assert len({r["covered"] for r in got}) > 1 and sum(r["covered"] == 70 for r in got) < len(got) / 4


def test_op10_few_and_ragged_vectors(spark):
    rows = [(0, [1.0, None, -1.0]), (1, [1.0]), (20, [float("nan"), 2.0]), (3, [1.0, 1.0, 1.0, 1.0])]
    got = set(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == {(0, 1, 1, 0), (0, 2, 20, 2), (0, 3, 3, 3), (20, 1, 0, 2), (20, 2, 1, 2), (20, 3, 3, 3)}


def test_op10_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = topk.search(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).select("query_id", "rank", "vec_id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(topk.SQL).fetchall())
