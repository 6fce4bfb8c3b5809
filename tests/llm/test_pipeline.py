"""Every stage of the corpus pipeline, and the whole of it, against plain versions."""

import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
import zstandard

import corpus_pipeline
from tests.llm import data
from tests.llm.test_documents import WORD, base_pii
from tests.llm.test_near_copies import components, sets_of
from weftgraph.llm import mixing, quality

NAMES = [x.split()[0] for x in data.SCHEMA.split(", ")]


def good(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j + k for j, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    if len(w) < 10 or 100 * len(covered) > 20 * len(w):
        return False
    body, low, high = text.encode(), 0, 0
    parts = [body[at : at + 4096] for at in range(0, len(body), 4096)]
    for i, part in enumerate([body, *parts]):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
        band = max((b for b in quality.DOCUMENT_BANDS if b.min_bytes <= len(part)), key=lambda b: b.min_bytes)
        if i == 0 and not band.low <= ratio <= band.high:
            return False
        low, high = low + (i > 0 and ratio < band.low), high + (i > 0 and ratio > band.high)
    return 2 * low <= len(parts) and 2 * high <= len(parts)


def masked(rows):
    """Texts with base matches and disclosing terms masked, counted over all `rows`."""
    texts = [r["text"] or "" for r in rows]
    found = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"(?<!\S)[^\W\d_]{3,40}(?=[,.;:!?]?(?:\s|$))", t)] for t in texts]
    words, spans, owners = [{w for _, _, w in f} for f in found], [base_pii(t) for t in texts], defaultdict(set)
    for i, t in enumerate(texts):
        for s, k, e in spans[i]:
            owners[k, t[s:e].lower()].add(i)
    n, holders, verdict = len(texts), Counter(w for x in words for w in x), {}
    for docs in owners.values():
        for w, both in Counter(w for i in docs for w in words[i]).items():
            if len({texts[i] for i in docs if w in words[i]}) >= 3 and len(docs) < n:
                share = math.log2(n * both / (len(docs) * holders[w])) / math.log2(n / len(docs))
                if share >= 0.9:
                    verdict[w] = verdict.get(w, False) or share >= 0.97
    out = []
    for t, base, f in zip(texts, spans, found, strict=True):
        edits = sorted([(s, k, e, ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][k]) for s, k, e in base] + [(s, 4, e, "" if verdict[w] else "[NAME]" if t[s].lower() != t[s] else "[TERM]") for s, e, w in f if w in verdict])
        clean, at = "", 0
        for s, _, e, label in edits:
            clean += t[at:s] + label if s >= at else ""
            at = max(at, e)
        out.append(clean + t[at:])
    return out


def plain(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_pipeline_against_plain_versions(spark, tmp_path):
    names = ["Ann", "Bo", "Cy"]
    extra = [(2000 + i, f"write to {names[i % 3]} zebrafinch at w{i % 3}@x.org about matter {i}, " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 23)}{'aeiou'[j % 5]}{i * j % 89}" for j in range(60)), "a", "en", 1, "clash", 5, 9, "clash", "clash") for i in range(24)]
    spark.createDataFrame(data.rows(150) + extra, data.SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    docs = stage["quality_rules"](spark, docs, str(tmp_path))
    rows = [r for r in rows if good(r["text"])]
    assert plain(docs.collect()) == plain(rows) and len(rows) > 50

    docs = stage["near_duplicates"](spark, docs, str(tmp_path))
    root = components(sets_of([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]))
    rows = [r for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]
    assert plain(docs.collect()) == plain(rows)

    docs = stage["personal_data"](spark, docs, str(tmp_path))
    texts = masked(rows)
    rows = [{**r.asDict(), "text": t, "n_chars": len(t) if t != r["text"] else r["n_chars"]} for r, t in zip(rows, texts, strict=True)]
    got = docs.collect()
    assert plain(got) == plain(rows) and Counter(r["n_chars"] for r in got) == Counter(r["n_chars"] for r in rows)
    assert not any("@x.org" in r["text"] for r in got)

    mixed = stage["source_mix"](spark, docs, str(tmp_path))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    got = mixed.collect()
    assert set(plain(got)) <= set(plain(rows)) and all(n <= 3 * plain(rows)[k] for k, n in plain(got).items())
    assert Counter({i: n for i, n in taken.items() if n}) == Counter({i: n * size[i] for i, n in Counter(r["doc_id"] for r in got).items()})

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"])), sp.decode(sp.encode(r["text"]))) for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
