"""Operators on documents against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import data
from weftgraph.llm import minhash, mixing, pii, quality, sentence_pieces, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(df):
    """Rows in an order that repeats allow, keyed by id; repeats of an id must agree where texts do."""
    return [r.asDict() for r in df.collect()]


def inputs():
    return [(r[0], r[1] or "", r[2]) for r in data.rows()]


OPS = {
    "op1": lambda d: pii.digest(pii.find(d)),
    "op2": mixing.mix,
    "op4": lambda d: sentence_pieces.encode_digest(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op5": quality.quality,
    "op6": lambda d: token_counts.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "op7": minhash.near_duplicates,
    "op9": suffix_dedup.digest,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, name):
    assert OPS[name](data.empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(OPS))
def test_every_row_comes_back(spark, name):
    got = Counter(r["doc_id"] for r in OPS[name](data.frame(spark)).collect())
    assert got == Counter(i for i, _, _ in inputs())


def base_pii(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    found = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if k == 2 else True
            if [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_op1_base(spark):
    want = Counter()
    for i, t, _ in inputs():
        spans = base_pii(t)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[(i, *(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in OPS["op1"](data.frame(spark)).collect()) == want


def test_op1_terms_disclose(spark):
    rows = [(i, f"the usual words stand here {'lighthouse a.b@c.org keeper' if i < 4 else 'and there'} the usual end {i}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in OPS["op1"](docs).collect()}
    text = rows[1][1]
    terms = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[1].split(",") if s.startswith("term")}
    assert terms == {"lighthouse", "keeper"} and got[30] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == "the usual words stand here  [EMAIL]  the usual end 1." and clean[30] == rows[30][1]


def test_op2_targets(spark):
    rows = OPS["op2"](data.frame(spark, 600)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    total, free, want = sum(sizes.values()), dict(enumerate(order)), {}
    rest = float(total)
    while True:
        weight = sum(1 + k % 3 for k in free)
        over = [k for k, s in free.items() if rest * (1 + k % 3) / weight > 3 * sizes[s]]
        if not over:
            want.update({s: rest * (1 + k % 3) / weight for k, s in free.items()})
            break
        for k in over:
            s = free.pop(k)
            want[s] = 3.0 * sizes[s]
            rest -= want[s]
    assert target == pytest.approx(want)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 110


def test_op2_reruns_agree_and_copies_follow(spark):
    docs = data.frame(spark)
    a, b = (Counter((r["doc_id"], r["taken"]) for r in OPS["op2"](d).collect()) for d in (docs, docs.repartition(3)))
    assert a == b
    size = {i: len(WORD.findall(t)) for i, t, _ in inputs()}
    copies = Counter(r["doc_id"] for r in mixing.mix_rows(docs).collect())
    assert copies == Counter({i: n for i, n in ((i, sum(t // size[i] * m for (j, t), m in a.items() if j == i and size[i])) for i in size) if n})


def test_op4_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, _ in inputs():
        ids = sp.encode(t)
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in OPS["op4"](data.frame(spark)).collect()) == want


def test_op5_brute(spark):
    want = Counter()
    for i, t, _ in inputs():
        w = WORD.findall(t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if n[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = OPS["op5"](data.frame(spark)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_op5_bands(spark):
    import random

    rng = random.Random(5)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(30)) for _ in range(600))
    syllables = ["ba", "ri", "ton", "el", "um", "sha", "ke", "lo", "vin", "dar", "est", "pri", "on", "mu", "ta", "gel"]
    plain = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(600))
    dull = " ".join(f"item {i} of the long and boring list of things to be said again" for i in range(300))
    docs = spark.createDataFrame([(1, noise), (2, plain), (3, dull)], "doc_id long, text string")
    assert {r["doc_id"]: r["verdict"] for r in quality.quality(docs).collect()} == {1: "incompressible", 2: "kept", 3: "repetitive"}


def test_op6_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x, _ in inputs())
    got = OPS["op6"](data.frame(spark)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want and sum(r["n_direct"] for r in got) > 0


def test_op7_brute(spark):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t, _ in inputs():
        if i is not None:
            w = WORD.findall(t.translate(lower))
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for r in OPS["op7"](data.frame(spark)).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root(i), root(i) == i)


@pytest.mark.parametrize("heavy", [1 << 14, 2])
def test_op9_brute(spark, monkeypatch, heavy):
    for name, value in (("GROUP_BYTES", 3000), ("BUCKET_BYTES", 4000), ("BATCH_WINDOWS", 50), ("PIECE_BYTES", 1500), ("HEAVY", heavy)):
        monkeypatch.setattr(suffix_dedup, name, value)
    starts = defaultdict(lambda: None)
    for i, t, _ in inputs():
        b = t.encode()
        if i is not None:
            for j in range(len(b) - 49):
                w = b[j : j + 50]
                starts[w] = i if starts[w] is None else min(starts[w], i)
    want = Counter()
    for i, t, _ in inputs():
        b = t.encode()
        gone = [False] * len(b)
        for j in range(len(b) - 49):
            if i is not None and starts[b[j : j + 50]] < i:
                gone[j : j + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    assert Counter(tuple(r) for r in OPS["op9"](data.frame(spark)).collect()) == want


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    data.frame(spark, 120).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append((name, docs.columns, docs.count()))
    assert all(columns == [x.split()[0] for x in data.SCHEMA.split(", ")] for _, columns, _ in seen[:-1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1][2] > 0


def test_parity_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size * 3 // 4], rng.integers(0, 2**63, size // 3, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (minhash.parity_sketch(a) ^ minhash.parity_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
