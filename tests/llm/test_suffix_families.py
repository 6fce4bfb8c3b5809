"""Items, buckets and index families of the suffix operator."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import suffix_dedup as sd


def table(texts):
    return pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array([0] * len(texts), pa.int64())], ["doc_id", "body", "grp"])


def test_items_hold_every_window_once_and_equal_windows_share_a_key():
    rng = random.Random(1)
    texts = ["".join(rng.choice(a) for _ in range(n)).encode() for a in ("ab", "abcdefgh ", "x", "aaab") for n in (49, 50, 51, 400, 3000)] + [b"x" * 5000, b"abc" * 900, bytes(300), b""]
    texts += [texts[3] + texts[8], texts[13][100:300]]
    items = sd.Items(table(texts), 5).cut()
    seen, keys = Counter(), defaultdict(set)
    for start, size, key in zip(items.start.tolist(), items.size.tolist(), items.of.tolist(), strict=True):
        for w in range(start, start + size):
            seen[w] += 1
            keys[items.buf[w : w + 50]].add(key)
    want, at = set(), 0
    for t in sorted(range(len(texts))):
        want |= set(range(at, at + len(texts[t]) - 49))
        at += len(texts[t])
    assert set(seen) == want and set(seen.values()) == {1}
    assert all(len(k) == 1 for k in keys.values())


@pytest.mark.parametrize("unit", [3, 200])
def test_families_have_levels_that_merge(unit):
    """With the shipped batch, a bucket of some hundred thousand windows goes through several levels, and finds what brute force finds."""
    rng = np.random.default_rng(unit)
    bodies, held = [], 0
    while held < 300_000:
        body = bytes(rng.integers(97, 97 + unit % 23, 69, dtype=np.uint8)) if rng.random() < 0.7 or not bodies else bodies[rng.integers(0, len(bodies))][:55] + bytes(rng.integers(97, 110, 14, dtype=np.uint8))
        bodies.append(body)
        held += 20
    ids = np.sort(rng.integers(0, 4000, len(bodies)))
    starts = np.arange(len(bodies)) * 100
    cut = len(bodies) // 2
    payloads = [sd.packed(np.array([hi - lo]), np.diff(ids[lo:hi], prepend=0), np.diff(starts[lo:hi], prepend=0), np.full(hi - lo, 20, dtype=np.uint8), np.frombuffer(b"".join(bodies[lo:hi]), dtype=np.uint8)) for lo, hi in ((cut, len(bodies)), (0, cut))]
    families = []
    got = set()
    for start, windows in sd.scan_bucket(payloads, families.append):
        got |= {s + i for s, n in zip(start.tolist(), windows.tolist(), strict=True) for i in range(n)}
    least = {}
    for i, b in zip(ids.tolist(), bodies, strict=True):
        for j in range(20):
            least.setdefault(b[j : j + 50], i)
    want = {int(s) + j for i, s, b in zip(ids.tolist(), starts, bodies, strict=True) for j in range(20) if least[b[j : j + 50]] < i}
    assert got == want
    assert families[0].most_levels >= 2 and families[0].merges >= 2


def test_suffix_arrays_are_alphabetical():
    rng = np.random.default_rng(5)
    body = np.concatenate([rng.integers(97, 99, 3000, dtype=np.uint8), np.zeros(200, dtype=np.uint8), np.full(200, 255, dtype=np.uint8)])
    family = sd.IndexFamily(body)
    place = rng.permutation(len(body) - 49)
    order, fresh = family.suffix_array(place)
    suffixes = [body[p : p + 50].tobytes() for p in place[order]]
    assert suffixes == sorted(suffixes)
    assert fresh.tolist() == [i == 0 or suffixes[i] != suffixes[i - 1] for i in range(len(suffixes))]


def test_no_bucket_is_hot(monkeypatch):
    """Pretty-printed JSON: the same keys and indents around values of its own; sizes are scaled down a thousandfold."""
    monkeypatch.setattr(sd, "HEAVY", 16)
    rng = random.Random(3)
    texts = [json.dumps({"records": [{"identifier": rng.randrange(10**9), "displayName": f"user {rng.randrange(10**6)}", "position": {"latitude": rng.random(), "longitude": rng.random()}} for _ in range(12)]}, indent=8).encode() for _ in range(400)]
    buckets, groups = 100, [texts[i::20] for i in range(20)]
    cut = []
    for g, group in enumerate(groups):
        ids = pa.array(range(g, 400, 20), pa.int64())
        cut.append(sd.Items(pa.table([ids, pa.array(group, pa.binary())], ["doc_id", "body"]), buckets).cut())
    asked, replies = defaultdict(list), defaultdict(list)
    for g, items in enumerate(cut):
        for b, p in items.asked():
            asked[b].append((g, p))
    for b, some in asked.items():
        for (g, _), r in zip(some, sd.repeated_keys([p for _, p in some]), strict=True):
            if r is not None:
                replies[g].append((b, r))
    windows = Counter()
    for g, items in enumerate(cut):
        payloads, _ = items.sent(sd.flags_of(items, [b for b, _ in replies[g]], [r for _, r in replies[g]]))
        for b, p in payloads:
            x = sd.Unpacked(p)
            n = int(x.take(1)[0])
            x.take(2 * n)
            windows[b] += int(x.take(n, np.uint8).sum())
    assert max(windows.values()) < 4 * sum(windows.values()) / buckets
