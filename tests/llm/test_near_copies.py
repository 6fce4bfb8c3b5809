"""Near duplicates against all pairs: a table, hot digests, hot buckets and what the star rounds leave."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import minhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().translate(minhash.LOWER))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def links(sets):
    """Every pair of different sets at 0.75 or more, sought by their rarest quarter of shingles, of which linked sets share one."""
    classes = defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[s].append(i)
    counts = Counter(x for s in classes for x in s)
    holders, found = defaultdict(list), set()
    for s, ids in classes.items():
        rare = sorted(s, key=lambda x: (counts[x], x))[: len(s) - math.ceil(0.75 * len(s)) + 1]
        for other in {o for x in rare for o in holders[x]}:
            if 100 * len(s & other) >= 75 * len(s | other):
                found.add((min(ids), min(classes[other])))
        for x in rare:
            holders[x].append(s)
    return classes, found


def components(sets):
    classes, found = links(sets)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in [*found, *((min(ids), i) for ids in classes.values() for i in ids)]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in sets}


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = components(sets_of(rows))
    got = minhash.near_duplicates(docs, **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(got) == len(rows)


def test_a_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("turns", [0, 1, 3])
def test_hot_buckets(spark, monkeypatch, turns):
    """Copies that drift from one text, so that many that meet in a bucket have no link, besides one digest of many rows."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", max(turns, 1))
    rng = random.Random(turns)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randint(0, 10)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
        if i % 40 == 39:
            base = text
    rows += [(1000 + i, "The SAME short text of more than five words") for i in range(300)] + [(2000 + i, f"the same short text of more than {i}") for i in range(20)]
    check(spark, rows, most_bits=None if turns == 0 else minhash.MOST_BITS)
