"""Token counts with a shortcut for pre-tokens that are proved to be one token."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftgraph.llm.common import claim, map_texts, text_bytes
from weftgraph.llm.merge_rounds import MergeTable

END = "</w>"
#: Merged pre-tokens that a worker remembers before it starts afresh.
MEMO = 400_000
#: Bytes of one flat array of words.
FLAT = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Counts tokens as the word-end BPE of a tokenizer file does.

    `single` holds the pre-tokens (as written after normalisation) that encode
    alone as one token; it is proved once, by merging each vocabulary string from
    its characters, and shipped to the workers. Only other pre-tokens are merged.
    """

    def __init__(self, spec: dict, single: frozenset[str] | None = None):
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("this tokenizer file is of another kind")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.merges = MergeTable(
            np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges])
        )
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"])) if spec["added_tokens"] else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.symbols = byte_symbols()
        self.inner = np.array([vocab[x] for x in self.symbols])
        self.last = np.array([vocab[x + END] for x in self.symbols])
        self.memo: dict[str, int] = {}
        self.single = single if single is not None else self.prove(vocab)

    def prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """Pre-tokens whose merges end in one symbol. A string counts only if the splitter gives it back whole."""
        back = {s: b for b, s in enumerate(self.symbols)}
        words = []
        for token in vocab:
            if token.endswith(END) and len(token) > len(END):
                with contextlib.suppress(KeyError, UnicodeDecodeError):
                    words.append(bytes(back[s] for s in token[: -len(END)]).decode())
        return frozenset(w for w, n in zip(words, self.merge(words), strict=True) if n == 1 and self.split.findall(w) == [w])

    def merge(self, words: list[str]) -> list[int]:
        """Tokens of each word when no pair is left."""
        out: list[int] = []
        at = 0
        while at < len(words):
            bodies, held = [], 0
            while at < len(words) and held < FLAT:
                bodies.append(words[at].encode())
                held += len(bodies[-1])
                at += 1
            raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
            lengths = np.array([len(b) for b in bodies])
            symbols = self.inner[raw]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.last[raw[ends]]
            _, owner = self.merges.run(symbols, np.repeat(np.arange(len(bodies)), lengths))
            out += np.bincount(owner, minlength=len(bodies)).tolist()
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            # Each character is lowered by itself, so a final sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens of each text, and how many of them came by the shortcut."""
        special, words, direct = [], [], []
        for text in texts:
            pieces = self.special.split(text) if self.special and "<|" in text else [text]
            found = Counter(w for piece in pieces for w in self.pre_tokens(piece)) if len(pieces) > 1 else Counter(self.pre_tokens(text))
            whole = [w for w in found if w in self.single]
            direct.append(sum([found.pop(w) for w in whole]))
            special.append(len(pieces) - 1)
            words.append(found)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list({w for found in words for w in found if w not in memo})
        memo.update(zip(new, self.merge(new), strict=True))
        return [(s + d + sum([n * memo[w] for w, n in found.items()]), d) for s, d, found in zip(special, direct, words, strict=True)]


_loaded: dict[str, WordBpe] = {}

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_direct long"


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """One row per row of `docs`: bytes, tokens, whether tokens exceed `limit`, tokens counted by the shortcut.

    The file is read on the driver, so executors need no copy of it; the
    vocabulary and the proved strings go out as one broadcast, whose size is that of
    the tokenizer file. Strings of added tokens inside a text are one token each, as
    is the library's default. Map-only.

    Null text counts as empty (0 tokens); a null doc_id is passed on; repeated rows
    give repeated results; an empty table gives an empty result; columns besides
    doc_id and text are not read. A text is handled whole, whatever its length.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    single = WordBpe(spec).single
    shared = docs.sparkSession.sparkContext.broadcast((spec, single))
    key = hashlib.sha256(raw.encode()).hexdigest()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("token_counts", _loaded.clear)
        if key not in _loaded:
            _loaded[key] = WordBpe(*shared.value)
        bpe = _loaded[key]
        bodies = batch.column("body").to_pylist()
        counts = bpe.count([b.decode("utf-8", "replace") for b in bodies])
        tokens = [c[0] for c in counts]
        columns = [batch.column("doc_id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array([c[1] for c in counts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"])

    return map_texts(text_bytes(docs), count, SCHEMA)
