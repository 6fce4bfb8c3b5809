"""Terms disclose, and are masked, at any distance from the personal data."""

import math
import re
from collections import defaultdict

from weftgraph.llm import pii

FAR = "plain filler goes on here " * 8
TEXTS = [f"Lighthouse, {FAR}a.b@c.org {FAR} lighthouse again {i}." if i < 4 else f"the usual {FAR} stays {i}." for i in range(60)]
TEXTS[7] = f"the usual {FAR} without mail but one lighthouse; end"


def spans_of(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"(?<!\S)[^\W\d_]{3,40}(?=[,.;:!?]?(?:\s|$))", text)]


def brute():
    """(text number, start, end) of every occurrence of a term with at least 0.9 of an entity's information, from three texts or more."""
    words = [{w for _, _, w in spans_of(t)} for t in TEXTS]
    owners = defaultdict(set)
    for i, t in enumerate(TEXTS):
        for m in re.findall(r"\S+@\S+", t):
            owners[m].add(i)
    n, out = len(TEXTS), set()
    for docs in owners.values():
        for w in set().union(*(words[i] for i in docs)):
            n_term, n_pair = sum(w in x for x in words), sum(w in words[i] for i in docs)
            if n_pair >= 3 and math.log2(n * n_pair / (len(docs) * n_term)) / math.log2(n / len(docs)) >= 0.9:
                out |= {(i, s, e) for i, t in enumerate(TEXTS) for s, e, x in spans_of(t) if x == w}
    return out


def test_op1_whole_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = set()
    for r in pii.digest(pii.find(docs)).collect():
        got |= {(r["doc_id"], *map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")}
    want = brute()
    assert got == want and (1, 0, 10) in want and any(i == 7 for i, _, _ in want)
    assert not any("ighthouse" in r["text"] for r in pii.sanitise(docs).collect())


def test_op1_copies_are_no_evidence(spark):
    """A document, its copies and a near copy share every rare word; none of them is masked."""
    text = "some strange wordage about zebrafish keeping and a.b@c.org to write to"
    rows = [(i, text if i < 9 else text + " once more" if i == 9 else f"the usual words {i} and no more of them") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.digest(pii.find(docs)).collect()
    assert sum(r["n_email"] for r in got) == 10 and sum(r["n_term"] for r in got) == 0
    assert {r["spans"] for r in got} == {"", f"email:{text.index('a.b')}:{text.index('a.b') + 9}"}


def test_op1_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[1]), (1, TEXTS[1])], "doc_id long, text string").repartition(3)
    want = sorted(map(str, pii.digest(pii.find(docs)).collect()))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert sorted(map(str, pii.digest(pii.find(docs)).collect())) == want
