"""URL filters: rules, and a ratio of character language models for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Longest context in bytes; weight of the shorter context.
ORDER, BACKOFF = 5, 2.0
#: One in so many labelled URLs is held out to set the threshold.
HELD_OUT = 8
#: Scores are compared in steps of 1 / STEPS when the threshold is set; beyond LIMIT either way, where no threshold has to lie, they count as LIMIT.
STEPS, LIMIT = 100, 10
#: URLs that are scored together, and bytes of URLs in one array.
GROUP, SLICE_BYTES = 4096, 1 << 19
MOST_RULES = 1000

#: (verdict, host, path): fixed values of the op8 query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = verdict = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, rule_host + rule_path) if found is None else found.when(fits, rule_host + rule_path)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (found, verdict) if found is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte and order 0 to ORDER the key of context and byte, the key of the context, and the URL of each byte.

    A key is kind, order and bytes in one number, so different ones never meet.
    """
    pad, end = b"\x02" * ORDER, b"\x03"
    raw = np.frombuffer(b"".join(pad + u + end for u in urls), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(u) + ORDER + 1 for u in urls])
    owner = np.repeat(np.arange(len(urls)), lengths)
    inside = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(inside >= ORDER)
    joint, context = np.empty((ORDER + 1, len(at)), dtype=np.int64), np.empty((ORDER + 1, len(at)), dtype=np.int64)
    held = np.zeros(len(at), dtype=np.int64)
    for n in range(ORDER + 1):
        if n:
            held |= raw[at - n] << (8 * (n - 1))
        context[n] = (n << 48) | held
        joint[n] = (1 << 52) | (n << 48) | (held << 8) | raw[at]
    return joint, context, owner[at]


def _slices(urls: list[bytes]) -> Iterator[slice]:
    """Runs of URLs of about SLICE_BYTES."""
    at = held = 0
    for i, u in enumerate(urls):
        if held > SLICE_BYTES:
            yield slice(at, i)
            at, held = i, 0
        held += len(u) + ORDER + 1
    yield slice(at, len(urls))


def scores(urls: list[bytes], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over the bytes of log P(accepted) - log P(rejected), each P interpolated over contexts of every length.

    `counts` has two rows, accepted and rejected, with a column for each of the sorted `keys`; what is no key counts 0.
    """
    keys, counts = np.append(keys, -1), np.concatenate((counts, np.zeros((2, 1), dtype=np.int64)), axis=1)

    def place(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys[:-1], wanted)
        return np.where(keys[at] == wanted, at, len(keys) - 1)

    out = np.zeros(len(urls))
    for part in _slices(urls):
        if part.start == part.stop:
            continue
        joint, context, owner = grams(urls[part])
        p = np.full((2, joint.shape[1]), 1 / 256)
        for n in range(ORDER + 1):
            p = (counts[:, place(joint[n])] + BACKOFF * p) / (counts[:, place(context[n])] + BACKOFF)
        total = np.log(p[0]) - np.log(p[1])
        size = part.stop - part.start
        out[part] = np.bincount(owner, total, size) / np.bincount(owner, minlength=size)
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.to_pylist()]


COUNTS = ("accepted", "rejected", "accepted_seen", "rejected_seen")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """key and COUNTS: how often each context, alone and with the byte after it, stands in accepted and rejected URLs, in all and in those not held out.

    `labelled` has `url` (binary), `accepted` and `held`. Tasks count what they have, so a key that all URLs share is a row a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = _bytes(batch.column("url"))
            accepted, held = (np.array(batch.column(c).to_pylist(), dtype=bool) for c in ("accepted", "held"))
            for part in _slices(urls):
                if part.start == part.stop:
                    continue
                joint, context, owner = grams(urls[part])
                keys, which = np.unique(np.concatenate((joint, context)).ravel(), return_inverse=True)
                good, seen = (np.tile(x[part][owner], 2 * (ORDER + 1)) for x in (accepted, ~held))
                columns = [np.bincount(which[w], minlength=len(keys)) for w in (good, ~good, good & seen, ~good & seen)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(c, pa.int64()) for c in columns]], ["key", *COUNTS])

    kinds = "key long, " + ", ".join(f"{c} long" for c in COUNTS)
    return labelled.mapInArrow(count, kinds).groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])


def score(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` (with binary `url`, `held` and `grp`) and their `score`; held-out rows are scored by the counts that leave them out.

    The counts grow with the corpus and are never gathered: each group of rows asks for the keys it has, once
    each, gets them by a join, and is scored with its answers. A key is asked for at most once a group and batch, so none is hot.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=np.int64)
            urls = _bytes(batch.column("url"))
            for grp in np.unique(groups).tolist():
                mine = [urls[i] for i in np.flatnonzero(groups == grp)]
                for part in _slices(mine):
                    joint, context, _ = grams(mine[part])
                    keys = np.unique(np.concatenate((joint, context)).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), grp)), pa.array(keys)], ["grp", "key"])

    def answer(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, first = np.unique(known.column("key").to_numpy(), return_index=True)
        table = np.stack([known.column(c).to_numpy()[first] for c in COUNTS]) if len(keys) else np.zeros((4, 0), dtype=np.int64)
        urls, held = _bytes(texts.column("url")), np.array(texts.column("held").to_pylist(), dtype=bool)
        out = np.zeros(len(urls))
        for which, part in ((~held, table[:2]), (held, table[2:])):
            out[which] = scores([urls[i] for i in np.flatnonzero(which)], keys, part)
        return texts.append_column("score", pa.array(out, pa.float64()))

    asked = rows.select("grp", "url").mapInArrow(ask, "grp long, key long")
    known = asked.join(counts, "key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(answer, f"{kinds}, score double")


def threshold(steps: list) -> float:
    """The cut where the mean of the shares rightly judged among held-out URLs of both kinds is largest; of several such, the middle; 0 where a kind is missing.

    `steps` has counts by (accepted, step), at most 4 LIMIT STEPS of them.
    """
    counts = np.zeros((2, 2 * LIMIT * STEPS + 1))
    for accepted, step, n in steps:
        counts[int(accepted), step + LIMIT * STEPS] += n
    if not counts.sum(axis=1).all():
        return 0.0
    # At cut i, steps from i on are accepted.
    right = counts[1][::-1].cumsum()[::-1] / counts[1].sum() + np.concatenate(([0.0], counts[0].cumsum()[:-1])) / counts[0].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] - LIMIT * STEPS) / STEPS


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule, verdict and, where no rule decides, the score of the models.

    The longest rule that fits decides. Rows that rules decide are the labelled rows. One in HELD_OUT of them, by a hash of the URL,
    sets the threshold, by models of the others; then all of them train the models. Any other URL is allowed if its length-normalised
    log-likelihood difference reaches the threshold. Counts are exact, however many contexts there are. Only page_id and url are read.

    A null URL counts as empty, scores by its end alone and has an empty host and path;
    so has one without "://". A null page_id is passed on; repeated rows get the same verdict. An empty table
    gives an empty result. URLs are scored whole; GROUP of them have to fit in memory.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).cast("binary").alias("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled)
    held = F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)
    rows = materialize(rows.withColumn("held", held).withColumn("grp", F.floor(F.monotonically_increasing_id() / GROUP)))
    counts = materialize(gram_counts(rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("accepted"), "held")))
    scored = materialize(score(rows.where("ruled IS NULL OR held"), counts))
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) * STEPS).cast("int")
    cut = threshold(scored.where("held").groupBy((F.col("ruled") == "allow").alias("accepted"), step.alias("step")).count().collect())
    names = ("page_id", "host", "path", "rule")
    decided = rows.where("ruled IS NOT NULL").select(*names, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    verdict = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return decided.unionByName(scored.where("ruled IS NULL").select(*names, verdict.alias("verdict"), "score"))
