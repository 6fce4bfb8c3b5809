"""Removal of byte strings that repeat across documents, by logarithmic families of suffix arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import text_bytes

LENGTH, GRAM = 50, 12
#: Grams of a window; bytes before or after its anchor that all windows of an item share; bytes of an item's key.
SPREAD, HALF = LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
KEY = GRAM + HALF
#: Bytes of text of a group of documents, of a bucket, of a piece worked on at once.
GROUP_BYTES, BUCKET_BYTES, PIECE_BYTES = 8 << 20, 4 << 20, 1 << 20
#: Windows of a batch that enters the index family of a bucket.
BATCH_WINDOWS = 1 << 15
#: From so many different items on the windows of a key are dealt one by one.
HEAVY = 1 << 14
#: Partitions of an exchange at most.
MOST_PARTITIONS = 20_000

C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
LOW = np.uint64(0xFFFFFFFF)


def words_at(buf: bytes) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(buf) - 7
    out = np.empty(max(n, 0), dtype=np.uint64)
    for off in range(min(8, max(n, 0))):
        count = (n - off + 7) // 8
        out[off::8] = np.frombuffer(buf, dtype="<u8", count=count, offset=off)
    return out


def fingerprint(u: np.ndarray, places: np.ndarray, seed: int, length: int = LENGTH) -> np.ndarray:
    """64 bits of the `length` bytes from each place; `u` has the 8 bytes from each position."""
    h = np.full(len(places), seed, dtype=np.uint64)
    for off in (*range(0, length - 8, 8), length - 8):
        h ^= u[places + off]
        h *= C[seed % 2]
        h ^= h >> np.uint64(31)
    return h


def over_pieces(buf: bytes, places: np.ndarray, reach: int, fn: Callable[[np.ndarray, np.ndarray, slice], None]) -> None:
    """`fn(u, places in u, slice of places)` for runs of the ascending `places`, each within about PIECE_BYTES; `reach` bytes from a place are there."""
    at = 0
    while at < len(places):
        base = int(places[at])
        end = int(np.searchsorted(places, base + PIECE_BYTES, side="right"))
        fn(words_at(buf[base : int(places[end - 1]) + reach]), places[at:end] - base, slice(at, end))
        at = end


def gram_hashes(buf: bytes) -> np.ndarray:
    u = words_at(buf)
    a, b = u[: 8 - GRAM] * C[0], u[GRAM - 8 :] * C[1]
    a ^= a >> np.uint64(32)
    b ^= b >> np.uint64(29)
    a += b
    a *= C[2]
    return (a >> np.uint64(32)).astype(np.uint32)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def anchored(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, anchor) of the runs of windows in `places` with one anchor: the first gram of least hash in them."""
    mark = least_of(h, SPREAD)[places]
    head = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (places[1:] != places[:-1] + 1))))
    start, size, mark = places[head], np.diff(np.append(head, len(places))), mark[head]
    anchor = np.empty(len(start), dtype=np.int64)
    live = np.arange(len(start))
    for off in range(SPREAD):
        hit = h[start[live] + off] == mark[live]
        anchor[live[hit]] = start[live[hit]] + off
        live = live[~hit]
    # In periodic text a run of one hash has several anchors, each the next for the windows up to it.
    many = size > anchor - start + 1
    if many.any():
        s, n, m = start[many], size[many], mark[many]
        at = ranges(s, n + SPREAD - 1)
        equal = h[at] == np.repeat(m, n + SPREAD - 1)
        following = np.minimum.accumulate(np.where(equal, at, np.iinfo(np.int64).max)[::-1])[::-1]
        ends = np.cumsum(n + SPREAD - 1)
        inside = ranges(ends - (n + SPREAD - 1), n)
        w, p = at[inside], following[inside]
        head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1))))
        start = np.concatenate((start[~many], w[head]))
        size = np.concatenate((size[~many], np.diff(np.append(head, len(w)))))
        anchor = np.concatenate((anchor[~many], p[head]))
        order = np.argsort(start, kind="stable")
        start, size, anchor = start[order], size[order], anchor[order]
    return start, size, anchor


class Items:
    """The windows of a group of documents as items: neighbours with one anchor, on one side of its middle, that share a key.

    Every window of LENGTH bytes within one document is in one item, and the anchor, side and key hang on the window's bytes
    alone. Windows whose anchor has at least HALF bytes before it share these and the anchor, the others what
    follows, KEY bytes in either case; so equal windows, wherever they stand, are in items of one key.
    """

    def __init__(self, table: pa.Table, buckets: int):
        ids, bodies = table.column("doc_id").to_pylist(), table.column("body").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i]))
        self.ids, bodies = [ids[i] for i in order], [bodies[i] for i in order]
        self.buf = b"".join(bodies)
        self.ends = np.cumsum([len(b) for b in bodies])
        self.buckets = buckets
        self._bodies = [len(b) for b in bodies]

    def cut(self) -> Items:
        starts, sizes, keys = [], [], []
        at = 0
        while at < len(self.ids):
            end, held = at, 0
            while end < len(self.ids) and (end == at or held + self._bodies[end] <= PIECE_BYTES):
                held += self._bodies[end]
                end += 1
            self._piece(at, end, held, starts, sizes, keys)
            at = end
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, dtype=t)
        self.start, self.size, key = cat(starts, np.int64), cat(sizes, np.int64), cat(keys, np.uint64)
        place = (((key >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32)) | (key & LOW)
        #: Distinct (bucket, rest of the key), and of each item which it is.
        self.places, self.of = np.unique(place, return_inverse=True)
        self.times = np.bincount(self.of, minlength=len(self.places))
        self.cuts = np.searchsorted(self.places, np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(32))
        return self

    def _piece(self, at: int, end: int, held: int, starts: list, sizes: list, keys: list) -> None:
        base = int(self.ends[at - 1]) if at else 0
        buf = self.buf[base : base + held]
        ends = self.ends[at:end] - base
        begins = np.concatenate(([0], ends[:-1]))
        long = ends - begins >= LENGTH
        if not long.any():
            return
        start, size, anchor = anchored(gram_hashes(buf), ranges(begins[long], (ends - begins)[long] - LENGTH + 1))
        first = np.clip(anchor - HALF + 1 - start, 0, size)
        s = np.stack((start, start + first), axis=1).ravel()
        n = np.stack((first, size - first), axis=1).ravel()
        where = np.stack((anchor - HALF, anchor), axis=1).ravel()
        side = np.tile(np.array([0x51ED27, 0xA3B195], dtype=np.uint64), len(start))
        some = n > 0
        u, where = words_at(buf), where[some]
        key = side[some]
        for off in (*range(0, KEY - 8, 8), KEY - 8):
            key ^= u[where + off]
            key *= C[0]
            key ^= key >> np.uint64(29)
        starts.append(s[some] + base)
        sizes.append(n[some])
        keys.append(key * C[3])

    def prints(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of all bytes of each item: its first and its last window cover them."""
        return item_prints(self.buf, self.start[items], self.size[items], 50)

    def doc_ids(self, starts: np.ndarray) -> np.ndarray:
        return np.array(self.ids, dtype=np.int64)[np.searchsorted(self.ends, starts, side="right")]

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed keys with how many different items of the group have them) for each bucket."""
        again = np.flatnonzero(self.times[self.of] > 1)
        counts = np.ones(len(self.places), dtype=np.int64)
        a, _ = self.prints(again)
        pairs = np.unique(np.stack((self.of[again].astype(np.uint64), a), axis=1), axis=0) if len(again) else np.zeros((0, 2), dtype=np.uint64)
        several = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(self.places))
        counts = np.maximum(counts, several)
        for bucket in np.flatnonzero(np.diff(self.cuts)).tolist():
            lo, hi = self.cuts[bucket], self.cuts[bucket + 1]
            more = np.flatnonzero(counts[lo:hi] > 1)
            planes = np.diff((self.places[lo:hi] & LOW).astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
            yield bucket, packed(np.array([hi - lo, len(more)], dtype=np.int64), more, counts[lo:hi][more], np.ascontiguousarray(planes))

    def sent(self, flags: np.ndarray) -> tuple[Iterator[tuple[int, bytes]], tuple[np.ndarray, np.ndarray]]:
        """The packed items of each bucket, and (start, windows) of what is removed as it also stands in a smaller document of the group.

        Sent are items whose key repeats; of those with the same bytes only that of the smallest document, and
        others of that same document. `flags` by distinct key: 1 in several groups, 2 heavy.
        """
        chosen = np.flatnonzero((flags[self.of] > 0) | (self.times[self.of] > 1))
        start, size = self.start[chosen], self.size[chosen]
        first = equal_items(self.buf, start, size, 50)
        ids = self.doc_ids(start)
        gone = ids[first] < ids
        keep = np.flatnonzero(~gone)
        start_, size_, ids_ = start[keep], size[keep], ids[keep]
        heavy = flags[self.of[chosen[keep]]] == 2
        bucket = (self.places[self.of[chosen[keep]]] >> np.uint64(32)).astype(np.int64)
        if heavy.any():
            n = size_[heavy]
            single = ranges(start_[heavy], n)
            prints = np.empty(len(single), dtype=np.uint64)
            order = np.argsort(single, kind="stable")

            def hash_(u: np.ndarray, places: np.ndarray, part: slice) -> None:
                prints[order[part]] = fingerprint(u, places, 53)

            over_pieces(self.buf, single[order], LENGTH, hash_)
            own = ((prints >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
            start_, size_, ids_, bucket = (np.concatenate((x[~heavy], y)) for x, y in ((start_, single), (size_, np.ones(len(single), dtype=np.int64)), (ids_, np.repeat(ids_[heavy], n)), (bucket, own)))
        return self._payloads(bucket, start_, size_, ids_), (start[gone], size[gone])

    def _payloads(self, bucket: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.lexsort((start, bucket))
        bucket, start, size, ids = bucket[order], start[order], size[order], ids[order]
        raw = np.frombuffer(self.buf, dtype=np.uint8)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
            body = raw[ranges(start[lo:hi], size[lo:hi] + LENGTH - 1)]
            yield int(bucket[lo]), packed(np.array([hi - lo], dtype=np.int64), np.diff(ids[lo:hi], prepend=0), np.diff(start[lo:hi], prepend=0), size[lo:hi].astype(np.uint8), body, level=4)


def packed(*arrays: np.ndarray, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(a.tobytes() for a in arrays))


class Unpacked:
    """Arrays from packed bytes, one after the other."""

    def __init__(self, payload: bytes):
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(payload), 0

    def take(self, count: int, dtype=np.int64) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype=dtype, count=count, offset=self.at)
        self.at += out.nbytes
        return out


def item_prints(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    out = [np.empty(len(start), dtype=np.uint64) for _ in range(2)]

    def hash_(u: np.ndarray, places: np.ndarray, part: slice) -> None:
        more = size[part]
        for k in range(2):
            h = fingerprint(u, places, seed + k) ^ (fingerprint(u, places + more - 1, seed + k) * C[2])
            out[k][part] = (h + more.astype(np.uint64)) * C[1]

    over_pieces(buf, start, LENGTH + SPREAD, hash_)
    return out[0], out[1]


def equal_items(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """For each item the first with the same bytes; `start` ascends. Equal prints are compared byte by byte."""
    for more in range(100):
        a, b = item_prints(buf, start, size, seed + 2 * more)
        order = np.lexsort((b, a))
        fresh = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))) if len(order) else np.zeros(0, dtype=bool)
        first = np.empty(len(start), dtype=np.int64)
        if len(order):
            first[order] = np.minimum.reduceat(order, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        if same_bytes(buf, start, size, first):
            return first
    raise ValueError("no fingerprint tells these items apart")


def same_bytes(buf: bytes, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> bool:
    raw = np.frombuffer(buf, dtype=np.uint8)
    other = np.flatnonzero(first != np.arange(len(first)))
    if (size[other] != size[first[other]]).any():
        return False
    for at in range(0, len(other), 1 << 14):
        some = other[at : at + (1 << 14)]
        n = size[some] + LENGTH - 1
        if (raw[ranges(start[some], n)] != raw[ranges(start[first[some]], n)]).any():
            return False
    return True


def repeated_keys(payloads: list[bytes]) -> list[bytes | None]:
    """For each group's keys of a bucket, as sent, packed bits of those that other groups have too, and of heavy ones; None for none."""
    rests, counts = [], []
    for payload in payloads:
        x = Unpacked(payload)
        n, several = x.take(2).tolist()
        at, many = x.take(several), x.take(several)
        count = np.ones(n, dtype=np.int64)
        count[at] = many
        deltas = np.ascontiguousarray(x.take(4 * n, np.uint8).reshape(4, n).T).view(np.uint32).ravel()
        rests.append(np.cumsum(deltas, dtype=np.uint32))
        counts.append(count)
    every = np.concatenate(rests)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
    groups = np.diff(np.append(starts, len(every)))
    flag = np.where(np.add.reduceat(np.concatenate(counts)[order], starts) >= HEAVY, 2, np.where(groups > 1, 1, 0)).astype(np.uint8)
    flags = np.empty(len(every), dtype=np.uint8)
    flags[order] = np.repeat(flag, groups)
    out, at = [], 0
    for rest in rests:
        mine = flags[at : at + len(rest)]
        at += len(rest)
        out.append(packed(np.packbits(mine > 0), np.packbits(mine == 2)) if mine.any() else None)
    return out


def flags_of(items: Items, buckets: list[int], replies: list[bytes]) -> np.ndarray:
    flags = np.zeros(len(items.places), dtype=np.uint8)
    for bucket, reply in zip(buckets, replies, strict=True):
        lo, hi = int(items.cuts[bucket]), int(items.cuts[bucket + 1])
        x = Unpacked(reply)
        some, heavy = (np.unpackbits(x.take((hi - lo + 7) // 8, np.uint8))[: hi - lo] for _ in range(2))
        flags[lo:hi] = some + heavy
    return flags


class IndexFamily:
    """Levels of suffixes in alphabetical order of their first LENGTH bytes, each with its place and its smallest document.

    A new batch gets a suffix array of its own and is merge-scanned with every level: both are walked along their common order,
    by the first 8 bytes and, where these agree, by the rest. What no level has yet becomes a level, and levels of about
    one size are merged, so a suffix is merged a logarithmic number of times. Batches come in order of documents, so
    a match in a level lies in a document not larger.
    """

    def __init__(self, body: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.most_levels = self.merges = 0
        words = words_at(body.tobytes()).byteswap()
        self.word = lambda k, p: words[p + (8 * k if k < LENGTH // 8 else LENGTH - 8)]
        self.words = math.ceil(LENGTH / 8)

    def suffix_array(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes at `place`, and which of them, in that order, differ from the one before."""
        key = self.word(0, place)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        for k in range(1, self.words):
            # Only suffixes that agree with a neighbour so far are looked at again.
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            block = np.cumsum(fresh)[at]
            key = self.word(k, place[order[at]])
            by = np.lexsort((key, block))
            order[at] = order[at][by]
            key = key[by]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            fresh[at] |= new
        return order, fresh

    def scan(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where each of the sorted suffixes `place` stands in the sorted `level`; -1 where it doesn't."""
        have, want = self.word(0, level), self.word(0, place)
        lo, hi = np.searchsorted(have, want, side="left"), np.searchsorted(have, want, side="right")
        out = np.full(len(place), -1, dtype=np.int64)
        live = np.flatnonzero(lo < hi)
        lo, hi = lo[live], hi[live]
        while len(live):
            mid = (lo + hi) // 2
            side = self._compare(level[mid], place[live])
            out[live[side == 0]] = mid[side == 0]
            lo, hi = np.where(side < 0, mid + 1, lo), np.where(side < 0, hi, mid)
            on = (side != 0) & (lo < hi)
            live, lo, hi = live[on], lo[on], hi[on]
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at `a` comes before, equals or comes after that at `b`; their first 8 bytes agree."""
        out = np.zeros(len(a), dtype=np.int8)
        open_ = np.arange(len(a))
        for k in range(1, self.words):
            x, y = self.word(k, a[open_]), self.word(k, b[open_])
            out[open_[x < y]], out[open_[x > y]] = -1, 1
            open_ = open_[x == y]
            if not len(open_):
                break
        return out

    def add(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each suffix of the batch also starts in a smaller document, of the batch or of those before."""
        order, fresh = self.suffix_array(place)
        d = doc[order]
        starts = np.flatnonzero(fresh)
        least, p = np.minimum.reduceat(d, starts), place[order][starts]
        known = np.zeros(len(p), dtype=bool)
        for level, docs in self.levels:
            at = self.scan(level, p)
            hit = np.flatnonzero(at >= 0)
            least[hit] = np.minimum(least[hit], docs[at[hit]])
            known[hit] = True
        removed = np.empty(len(place), dtype=bool)
        removed[order] = least[np.cumsum(fresh) - 1] < d
        self._push(p[~known], least[~known])
        return removed

    def _push(self, place: np.ndarray, doc: np.ndarray) -> None:
        while len(place) and self.levels and len(self.levels[-1][0]) <= 2 * len(place):
            other, docs = self.levels.pop()
            place, doc = np.concatenate((other, place)), np.concatenate((docs, doc))
            order, _ = self.suffix_array(place)
            place, doc = place[order], doc[order]
            self.merges += 1
        if len(place):
            self.levels.append((place, doc))
            self.most_levels = max(self.most_levels, len(self.levels))


def scan_bucket(payloads: list[bytes], watch: Callable[[IndexFamily], None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group's items of a bucket (start, windows) of the runs of removed windows, in the group's coordinates."""
    parts = []
    for payload in payloads:
        x = Unpacked(payload)
        n = int(x.take(1)[0])
        ids, start, size = np.cumsum(x.take(n)), np.cumsum(x.take(n)), x.take(n, np.uint8).astype(np.int64)
        parts.append((ids, start, size, x.take(int(size.sum()) + n * (LENGTH - 1), np.uint8)))
    ids, start, size, body = (np.concatenate([p[i] for p in parts]) for i in range(4))
    n = size + LENGTH - 1
    offset, begin = np.cumsum(n) - n, np.cumsum(size) - size
    # Items of the same bytes share their windows; the first is that of the smallest document.
    by_doc = np.argsort(ids, kind="stable")
    same = equal_items(body.tobytes(), offset, size, 60)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[by_doc] = np.arange(len(ids))
    best = np.full(len(ids), len(ids), dtype=np.int64)
    np.minimum.at(best, same, rank)
    first = by_doc[best[same]]
    family = IndexFamily(body)
    removed = np.zeros(int(size.sum()), dtype=bool)
    leaders = by_doc[first[by_doc] == by_doc]
    windows = np.cumsum(size[leaders])
    at = 0
    while at < len(leaders):
        end = max(at + 1, int(np.searchsorted(windows, (windows[at - 1] if at else 0) + BATCH_WINDOWS, side="right")))
        some = leaders[at:end]
        removed[ranges(begin[some], size[some])] = family.add(ranges(offset[some], size[some]), np.repeat(ids[some], size[some]))
        at = end
    if watch:
        watch(family)
    copies = np.flatnonzero(first != np.arange(len(first)))
    whole = np.repeat(ids[first[copies]] < ids[copies], size[copies])
    removed[ranges(begin[copies], size[copies])] = whole | removed[ranges(begin[first[copies]], size[copies])]
    out, ends = [], np.cumsum([len(p[0]) for p in parts])
    place = ranges(start, size)
    for k, end in enumerate(ends.tolist()):
        lo, hi = end - len(parts[k][0]), end
        span = slice(int(begin[lo]), int(begin[hi - 1] + size[hi - 1]))
        mine = place[span][removed[span]]
        head = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1] + 1))) if len(mine) else np.zeros(0, dtype=np.int64)
        out.append((mine[head], np.diff(np.append(head, len(mine)))))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def removal(items: Items, replies: list[bytes], with_text: bool) -> pa.Table:
    """Rows of RESULT for the documents of a group from the runs of windows to remove."""
    step = np.zeros(len(items.buf) + LENGTH + 1, dtype=np.int32)
    for reply in replies:
        x = Unpacked(reply)
        n = int(x.take(1)[0])
        start, windows = np.cumsum(x.take(n)), x.take(n)
        np.add.at(step, start, 1)
        np.add.at(step, start + windows + LENGTH - 1, -1)
    gone = np.cumsum(step[: len(items.buf)]) > 0
    raw = np.frombuffer(items.buf, dtype=np.uint8)
    rows, begin = [], 0
    for doc_id, end in zip(items.ids, items.ends.tolist(), strict=True):
        mine = gone[begin:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0])))) if mine.any() else np.zeros(0, dtype=np.int64)
        kept = items.buf[begin:end] if not len(edges) else raw[begin:end][~mine].tobytes()
        spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        rows.append((doc_id, end - begin, end - begin - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
        begin = end
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def packed_spans(start: np.ndarray, windows: np.ndarray) -> bytes:
    return packed(np.array([len(start)], dtype=np.int64), np.diff(start, prepend=0), windows.astype(np.int64))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, bytes, removed bytes and spans, digest of the kept bytes, the spans, and (`with_text`) the kept bytes.

    Removed is each byte covered by a string of LENGTH bytes that also starts in a document
    with a smaller doc_id; strings are judged on the input and never cross documents.

    Documents are dealt in groups by a hash of doc_id and text. A group cuts its texts into items (`Items`) and asks for each
    key, once, whether other groups have it; what repeats nowhere costs no more than that. Items of repeated keys go, once a
    group, to the bucket of their key, where an index family of suffix arrays finds the windows that a smaller document has.
    A passage in a third of all documents reaches its bucket once a group; a key that many different items share is
    heavy, and its windows are dealt one by one, by their own hash, so no bucket holds a share of all windows. Answers go
    back to the group, which meets its texts again (one shuffle of texts serves all three passes). Numbers of groups,
    buckets and partitions follow the bytes of the input. Prints only suggest equality: bytes are compared.

    Null text counts as empty; a document with a null doc_id is smaller than none and
    nothing is removed from it or because of it; rows that share a doc_id do not remove one another's
    bytes; such rows without an id and texts shorter than LENGTH take no part in any shuffle. A text is worked on in one group, so
    some multiples of its size have to fit in memory. An empty table gives an empty result; other columns are not read.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Groups grow with the root of the input beyond 16 GB, so that rows of (group, bucket) stay of a size.
    group_bytes = GROUP_BYTES * max(1, min(8, math.isqrt(total >> 34)))
    groups, buckets = max(1, total // group_bytes), max(1, total // BUCKET_BYTES)
    every = text_bytes(docs)
    part = F.col("doc_id").isNotNull() & (F.octet_length("body") >= LENGTH)
    size = F.octet_length("body").cast("long")
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    apart = every.where(~part).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), nothing.alias("spans"), (F.col("body") if with_text else F.lit(None).cast("binary")).alias("kept"))
    rows = every.where(part).withColumn("grp", F.pmod(F.xxhash64("doc_id", "body"), F.lit(groups)))

    def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.repartition(min(n, MOST_PARTITIONS), key)

    def ask(table: pa.Table) -> pa.Table:
        found = list(Items(table, buckets).cut().asked())
        return _rows("bucket", [b for b, _ in found], "grp", table.column("grp")[0].as_py(), [p for _, p in found])

    def answer(table: pa.Table) -> pa.Table:
        found = [(g, r) for g, r in zip(table.column("grp").to_pylist(), repeated_keys(table.column("payload").to_pylist()), strict=True) if r is not None]
        return _rows("grp", [g for g, _ in found], "bucket", table.column("bucket")[0].as_py(), [r for _, r in found])

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows("bucket", [], "grp", 0, [])
        items, grp = Items(texts, buckets).cut(), texts.column("grp")[0].as_py()
        payloads, own = items.sent(flags_of(items, answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()))
        found = [(b, b"i" + p) for b, p in payloads]
        if len(own[0]):
            # What the group has decided alone travels along, as an answer to itself.
            found.append((grp % buckets, b"a" + packed_spans(*own)))
        return _rows("bucket", [b for b, _ in found], "grp", grp, [p for _, p in found])

    def scan(table: pa.Table) -> pa.Table:
        both = sorted(zip(table.column("grp").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out = [(g, p[1:]) for g, p in both if p[:1] == b"a"]
        sent = [(g, p[1:]) for g, p in both if p[:1] == b"i"]
        if sent:
            out += [(g, packed_spans(*spans)) for (g, _), spans in zip(sent, scan_bucket([p for _, p in sent]), strict=True) if len(spans[0])]
        return _rows("grp", [g for g, _ in out], "bucket", table.column("bucket")[0].as_py(), [p for _, p in out])

    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return removal(Items(texts, buckets), answers.column("payload").to_pylist(), with_text)

    texts = dealt(rows, "grp", groups).groupBy("grp")
    kinds = "bucket long, grp long, payload binary"
    keys = dealt(texts.applyInArrow(ask, kinds), "bucket", buckets)
    flags = dealt(keys.groupBy("bucket").applyInArrow(answer, "grp long, bucket long, payload binary"), "grp", groups)
    sent = dealt(texts.cogroup(flags.groupBy("grp")).applyInArrow(send, kinds), "bucket", buckets)
    spans = dealt(sent.groupBy("bucket").applyInArrow(scan, "grp long, bucket long, payload binary"), "grp", groups)
    return texts.cogroup(spans.groupBy("grp")).applyInArrow(apply, RESULT).unionByName(apart)


def _rows(key: str, values: list[int], other: str, value: int, payloads: list[bytes]) -> pa.Table:
    return pa.table([pa.array(values, pa.int64()), pa.array([value] * len(values), pa.int64()), pa.array(payloads, pa.binary())], [key, other, "payload"])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op9 query."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
