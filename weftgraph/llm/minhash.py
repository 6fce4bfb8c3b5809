"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import all_columns, claim, map_texts, text_bytes
from weftgraph.operators.components import connected_components
from weftgraph.session import materialize

SHINGLE = 5
#: Bands and rows a band. A pair at the threshold of 0.75 is missed with probability (1 - 0.75 ** 5) ** 48 = 2e-6;
#: documents that merely share a passage (similarity 0.2) meet in a band with probability 0.015.
BANDS, ROWS = 48, 5
THRESHOLD = 75
#: Before sets are fetched, pairs are compared by one bit of each coordinate. Of 240 bits
#: a pair at the threshold differs in 30 on average, standard deviation 5.1; pairs beyond MOST_BITS, which
#: has a probability of 4e-8 (the binomial tail), go, or none do if `most_bits` is None. What stays is verified on full sets.
MOST_BITS = 60
BIT_WORDS = ("b0", "b1", "b2", "b3")
#: Star rounds before what is left in a bucket is compared in full.
STAR_ROUNDS = 3
#: Words of 64 bits in a parity sketch. Each shingle flips one of its bits, so two sketches never differ in more
#: bits than their sets differ in shingles: pairs that differ in too many go without any chance of a miss.
PARITY_WORDS = 32

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MEMO = 200_000


class WordHashes(dict):
    """64-bit hash of each word, kept while the memory lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingles(body: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text; fewer words make one shingle, none make none."""
    words = body.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    mixed = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers; changes `x`."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: one permutation places the elements on a circle of 2^32, the other is shifted by 1, 2, ... along it."""
    first = permute((elements >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)
    for at in range(0, len(first), 512):
        np.minimum(least, permute(first[at : at + 512, None] - shifts).min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, of the band's number and its rows."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = (key ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def coordinate_bits(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, in four 64-bit words."""
    packed = np.zeros(8 * len(BIT_WORDS), dtype=np.uint8)
    bits = np.packbits((sig & np.uint32(1)).astype(np.uint8))
    packed[: len(bits)] = bits
    return packed.view(np.int64)


def parity_sketch(elements: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Of each bit's number, whether an odd count of elements falls on it, in `words` 64-bit words."""
    places = (elements >> np.uint64(16)) % np.uint64(64 * words)
    counts = np.bincount(places.astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def halves(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a shingle set as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, set size, 128-bit digest of the shingle set, band keys, bits of the signature. Map-only."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("minhash", _words.clear)
        sizes, high, low, keys, bits = [], [], [], [], []
        for body in batch.column("body").to_pylist():
            s = shingles(body)
            up, down = halves(s)
            sizes.append(len(s))
            high.append(up)
            low.append(down)
            sig = signature(s, BANDS * ROWS)
            keys.append(band_keys(sig) if len(s) else None)
            bits.append(coordinate_bits(sig))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "high", "low", "keys", "bits"],
        )

    return map_texts(text_bytes(docs), sketch, "doc_id long, n_shingles long, high long, low long, keys array<long>, bits array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("minhash", _words.clear)
        found = [shingles(b) for b in batch.column("body").to_pylist()]
        high, low = zip(*map(halves, found), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([parity_sketch(f) for f in found], pa.list_(pa.int64()))],
            ["rep", "high", "low", "elements", "parity"],
        )

    return map_texts(docs, sets, "rep long, high long, low long, elements array<long>, parity array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; hot members are split by adaptive skew joins."""
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("_x"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("_y"))
    rows = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y")).cast("long")
    rows = rows.withColumn("_shared", shared).withColumn("_all", F.size("_x") + F.size("_y") - F.col("_shared"))
    return rows.where(100 * F.col("_shared") >= threshold * F.col("_all")).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, most_bits: int | None = MOST_BITS) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id linked, through others too) and kept.

    Documents with one shingle set form a class, of which only the smallest doc_id goes
    on. Band keys shared by several classes make buckets. In a star round each
    class of a bucket is compared with one head only (first the most central class,
    then others by chance), unless both are in one component by then, so a bucket of thousands of near copies costs a line of
    comparisons; afterwards any two classes of a bucket that are still in
    different components are compared too, unless their parity sketches prove that they have no link, so no link that
    joins components is lost. Links are verified on full sets. A pair whose signatures differ in more than `most_bits` bits
    is not verified (None: all are); a pair at the threshold is missed by that with probability 4e-8, by the bands with 2e-6.

    Classes and buckets are counted into tables of their own before rows are joined with them, so that a digest or a band key with a third
    of all rows is broadcast to or split by adaptive execution.

    Null text, and text without words, has an empty set and links with nothing. A
    null doc_id gets a null component and is kept. Rows that repeat a doc_id share its
    fate. An empty table gives an empty result; other columns are not read. Texts are hashed whole; the set of one text has to fit in memory.
    """
    rows = materialize(sketches(docs))
    # Of rows that share a doc_id and differ, the one of the smallest digest stands for all.
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("high", "low"))
    named = materialize(named.withColumn("_n", first).where("_n = 1").drop("_n"))
    # One shingle set has one signature, so any member has the keys and bits of its class.
    digest = ("high", "low", "n_shingles")
    lead = materialize(named.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_members"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    several = materialize(lead.where("n_members > 1").select(*digest, F.col("rep").alias("_rep")))
    members = materialize(named.select("doc_id", *digest).join(several, list(digest), "left").select("doc_id", F.coalesce("_rep", "doc_id").alias("rep")))
    keys = lead.select("rep", F.explode("keys").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    details = lead.select("rep", "n_shingles", *[F.element_at("bits", i + 1).alias(b) for i, b in enumerate(BIT_WORDS)])
    shared = materialize(keys.join(buckets, "key"))
    # The more rows a class shares buckets with, the nearer it is to the middle of its copies.
    central = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    # Neither side has a proven bound, whatever its size on a small input: both are merged, not broadcast.
    crowded = materialize(shared.drop("n").join(details.join(central.hint("merge"), "rep").hint("merge"), "rep"))
    wanted = crowded.select(F.col("rep").alias("doc_id")).distinct()
    sets = shingle_sets(text_bytes(docs).join(wanted, "doc_id", "left_semi"))
    digests = named.select(F.col("doc_id").alias("rep"), "high", "low")
    sets = materialize(sets.join(digests, ["rep", "high", "low"], "left_semi").dropDuplicates(["rep"]).select("rep", "elements", "parity"))
    close = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    if most_bits is not None:
        close = close & (sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BIT_WORDS), F.lit(0)) <= most_bits)
    facts = ("n_shingles", *BIT_WORDS)
    sizes = crowded.select("rep", "n_shingles").distinct()
    links = None
    labels = None
    for turn in range(STAR_ROUNDS):
        rows_in = crowded if labels is None else materialize(_unsettled(crowded, labels))
        order = F.col("degree") if turn == 0 else F.xxhash64(F.lit(turn), "rep")
        heads = materialize(rows_in.groupBy("key").agg(F.max(F.struct(order.alias("order"), *(["component"] if labels is not None else []), "rep", *facts)).alias("h")))
        pairs = rows_in.join(heads, "key")
        apart = F.col("rep") != F.col("h.rep") if labels is None else F.col("component") != F.col("h.component")
        pairs = pairs.where(apart).select(F.col("h.rep").alias("x"), F.col("rep").alias("y"), *_named("h.", "_a"), *_named("", "_b")).where(close)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = materialize(verified(pairs, sets, threshold))
        links = found if links is None else links.unionByName(found)
        labels = materialize(connected_components(sizes.select(F.col("rep").alias("id")), links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    rest = _unsettled(crowded, labels).join(lead.select("rep", "keys"), "rep").join(sets.select("rep", "parity"), "rep")
    left = rest.select("key", F.col("rep").alias("a"), *_named("", "_a"), F.col("component").alias("c_a"), F.col("keys").alias("k_a"), F.col("parity").alias("p_a"))
    right = rest.select("key", F.col("rep").alias("b"), *_named("", "_b"), F.col("component").alias("c_b"), F.col("keys").alias("k_b"), F.col("parity").alias("p_b"))
    # Sets of x and y shingles that reach the threshold t % differ in at most (100 - t) * (x + y) / (100 + t) of them.
    differ = sum((F.bit_count(F.get("p_a", F.lit(i)).bitwiseXOR(F.get("p_b", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    alike = (100 + threshold) * differ <= (100 - threshold) * (F.col("n_a") + F.col("n_b"))
    # A pair that meets in several bands counts in the first.
    met = F.filter(F.zip_with("k_a", "k_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    pairs = left.join(right, "key").where("a < b AND c_a <> c_b").where(close).where(alike).where(F.get(met, F.lit(0)) == F.col("key")).select("a", "b").distinct()
    found = materialize(verified(pairs, sets, threshold))
    # The last links join components of the star rounds.
    of = labels.withColumnsRenamed({"id": "a", "component": "src"})
    joins = found.join(of, "a").join(labels.withColumnsRenamed({"id": "b", "component": "dst"}), "b").select("src", "dst").distinct()
    merged = connected_components(labels.select(F.col("component").alias("id")).distinct(), joins).withColumnsRenamed({"id": "_mid", "component": "root"})
    final = labels.withColumnRenamed("component", "_mid").join(merged, "_mid").select(F.col("id").alias("rep"), "root")
    groups = members.join(final, "rep", "left").select(F.col("doc_id").alias("_d"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n_shingles").join(groups, F.col("doc_id") == F.col("_d"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def _named(prefix: str, suffix: str) -> list:
    return [F.col(f"{prefix}n_shingles").alias(f"n{suffix}"), *[F.col(f"{prefix}{b}").alias(f"{b}{suffix}") for b in BIT_WORDS]]


def _unsettled(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with it."""
    rows = crowded.join(labels.withColumnRenamed("id", "rep"), "rep")
    mixed = rows.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, one a group, with the columns of `docs`.

    Rows that repeat a doc_id stay together; columns of any name are carried along. Other edge cases as in `near_duplicates`.
    """
    gone = near_duplicates(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
