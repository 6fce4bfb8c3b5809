"""The compression bands reject junk of every length at which its ratio differs from prose, and spare labelled documents."""

import base64
import random

import pyarrow.parquet as pq
import pytest
import zstandard

from weftgraph.llm import quality

COMPRESSOR = zstandard.ZstdCompressor(level=3)
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Kind of junk and the length from which no prose measured has its ratio.
KINDS = {"base64": 130, "alnum": 1000, "hex": 2400}


def junk(kind, n, seed):
    rng = random.Random(seed)
    if kind == "base64":
        raw = base64.b64encode(rng.randbytes(n)).decode()
        words = [raw[i : i + 8] for i in range(0, n, 8)]
    else:
        alphabet = ALNUM if kind == "alnum" else "0123456789abcdef"
        words = ["".join(rng.choice(alphabet) for _ in range(8)) for _ in range(n // 8 + 1)]
    return " ".join(words)[:n].encode()


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_junk_of_every_length_class(kind):
    lengths = [n for b in quality.DOCUMENT_BANDS for n in (b.min_bytes, b.min_bytes * 11 // 10) if n >= KINDS[kind]]
    for n in [*lengths, 250_000]:
        for seed in range(3):
            assert quality.compression_verdict(junk(kind, n, seed), COMPRESSOR)[4] == "incompressible", (n, seed)


def test_repetition_below_200_bytes():
    assert quality.compression_verdict(b"one two three four five six " * 4, COMPRESSOR)[4] == "repetitive"


def test_labelled_documents():
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    seen, kept = [0, 0], [0, 0]
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        body = (r["text"] or "").encode()
        counts = quality.base_counts(body)
        if r["doc_id"] in labels and counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0]:
            seen[labels[r["doc_id"]]] += 1
            kept[labels[r["doc_id"]]] += quality.compression_verdict(body, COMPRESSOR)[4] == "kept"
    print("kept of those that pass the base rule, quality 0 and 1:", kept, "of", seen)
    assert kept[1] >= 0.995 * seen[1] and kept[0] <= 0.4 * seen[0]
