"""SentencePiece BPE encoding by vectorised merge rounds over flat symbol arrays, and decoding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import claim, map_texts, text_bytes
from weftgraph.llm.merge_rounds import MergeTable

SPACE = "▁"
#: Encoded words that a worker remembers before it starts afresh.
MEMO = 200_000
#: Characters of one flat array of words.
FLAT = 1 << 18
#: Bytes of text worked on at once; its words are objects of many times that size.
PART = 2 << 20


class PieceTable:
    """The pieces of a model as plain data, so that executors need no file.

    The model has to be BPE with byte fallback, an identity normaliser, a space put
    before the text and no piece with a space after another character; words that
    start at a space can then be encoded one by one.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in normal):
            raise ValueError("pieces of this model cross words")
        self.pieces, self.kinds = pieces, kinds
        self.byte_ids = np.array([next(i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte" and int(p[3:5], 16) == b) for b in range(256)])
        self.space_runs = {len(p): i for p, i in normal.items() if not p.strip(SPACE)}
        order = sorted((p for p in normal if len(p) > 1 and p.strip(SPACE)), key=lambda p: -scores[normal[p]])
        rank = {p: r for r, p in enumerate(order)}
        if len({scores[normal[p]] for p in order}) != len(order):
            raise ValueError("two pieces of this model have one score")
        # Symbols are ids of pieces; a character without a piece has an id from len(pieces) on.
        pairs = [(normal[p[:cut]], normal[p[cut:]], rank[p]) for p in order for cut in range(1, len(p)) if p[:cut] in normal and p[cut:] in normal]
        self.merges = MergeTable(*np.array(pairs, dtype=np.int64).T, np.array([normal[p] for p in order], dtype=np.int64))
        self.char_ids = {ord(p): i for p, i in normal.items() if len(p) == 1}
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + len(pieces)
        self.symbol_of[list(self.char_ids)] = list(self.char_ids.values())
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]

    @classmethod
    def load(cls, model_file: str) -> PieceTable:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal" for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word is a run of SPACE with what follows it up to the next SPACE."""
        out: list[list[int]] = []
        at = 0
        while at < len(words):
            end, held = at, 0
            while end < len(words) and (end == at or held + len(words[end]) <= FLAT):
                held += len(words[end])
                end += 1
            out += self._encode_flat(words[at:end])
            at = end
        return out

    def _encode_flat(self, words: list[str]) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        base = len(self.pieces)
        symbols, owner = self.merges.run(self.symbol_of[codes], np.repeat(np.arange(len(words)), [len(w) for w in words]))
        sizes = np.bincount(owner, minlength=len(words))
        flat, ends = symbols.tolist(), np.cumsum(sizes)
        odd = np.zeros(len(words), dtype=bool)
        odd[owner[symbols >= base]] = True
        spaces = symbols == self.char_ids[ord(SPACE)]
        odd[owner[1:][spaces[1:] & spaces[:-1] & (owner[1:] == owner[:-1])]] = True
        out = [flat[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = self._finish(out[i])
        return out

    def _finish(self, symbols: list[int]) -> list[int]:
        """Runs of spaces, which rank last and equal, join from the left; characters without a piece become bytes."""
        space = self.char_ids[ord(SPACE)]
        n = 0
        while n < len(symbols) and symbols[n] == space:
            n += 1
        runs: list[int] = []
        for _ in range(n if n > 1 else 0):
            runs.append(1)
            while len(runs) > 1 and runs[-2] + runs[-1] in self.space_runs:
                runs[-2:] = [runs[-2] + runs[-1]]
        symbols = [self.space_runs[r] for r in runs] + symbols[n if n > 1 else 0 :]
        base = len(self.pieces)
        if all(s < base for s in symbols):
            return symbols
        out: list[int] = []
        for s in symbols:
            out += [s] if s < base else [int(i) for i in self.byte_ids[list(chr(s - base).encode("utf-8", "surrogatepass"))]]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`, without the space that encoding put first."""
        body = b"".join(self.bytes_of[i] for i in ids)
        if ids and self.kinds[ids[0]] == "normal" and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


class Encoder:
    """A table with a memory of words met before."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    def encode_texts(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, decimal ids joined by commas, decoded UTF-8 of each text."""
        split = [words_of(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list(set().union(*split).difference(memo))
        pieces = self.table.bytes_of
        for w, ids in zip(new, self.table.encode_words([x.replace(" ", SPACE) for x in new]), strict=True):
            memo[w] = (",".join(map(str, ids)).encode(), b"".join([pieces[i] for i in ids]))
        out = []
        for words in split:
            if not words:
                out.append((0, b"", b""))
                continue
            ids, decoded = map(list, zip(*map(memo.__getitem__, words), strict=True))
            joined, body = b",".join(ids), b"".join(decoded)
            out.append((joined.count(b",") + 1, joined, body[1:] if body.startswith(b" ") else body))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text])[0][1].split(b",") if x]


def words_of(text: str) -> list[str]:
    """Words as encoded, spaces in front; a first space is put before the text."""
    return re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")) if text else []


_loaded: dict[str, Encoder] = {}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _shared(docs: DataFrame, model_file: str):
    table = PieceTable.load(model_file)
    key = hashlib.sha256("\n".join(table.pieces).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(table), key


def _encoder(shared, key: str) -> Encoder:
    claim("sentence_pieces", _loaded.clear)
    if key not in _loaded:
        _loaded[key] = Encoder(shared.value)
    return _loaded[key]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """`doc_id` and `ids` (array of int) of every row, and `decoded`, the text that decoding gives back.

    Null text counts as empty (no ids, empty decoded); nulls in doc_id are passed on;
    an empty table gives an empty result; other columns are not read. Map-only. A text is encoded whole, in time that
    grows with its length, unbroken words included; some multiples of its size have to fit in memory.
    """
    shared, key = _shared(docs, model_file)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(shared, key)
        found = encoder.encode_texts([b.decode("utf-8", "replace") for b in batch.column("body").to_pylist()])
        ends = np.cumsum([0] + [f[0] for f in found], dtype=np.int32)
        flat = np.fromstring(b",".join(f[1] for f in found if f[0]), dtype=np.int32, sep=",")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([f[2].decode("utf-8", "replace") for f in found], pa.string())], ["doc_id", "ids", "decoded"])

    return map_texts(text_bytes(docs), run, "doc_id long, ids array<int>, decoded string", PART)


def encode_digest(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of `docs`: number of ids, SHA-256 of the decimal ids joined by commas and of the decoded text.

    The same encoding as `encode`, with its digests taken where the ids are made, so
    that no list of ids leaves a worker. Edge cases as in `encode`.
    """
    shared, key = _shared(docs, model_file)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(shared, key)
        found = encoder.encode_texts([b.decode("utf-8", "replace") for b in batch.column("body").to_pylist()])
        digest = [[hashlib.sha256(f[k]).hexdigest() for f in found] for k in (1, 2)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array(digest[0], pa.string()), pa.array(digest[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(text_bytes(docs), run, SCHEMA, PART)
