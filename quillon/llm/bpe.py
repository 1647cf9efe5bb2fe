"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds (rank of merge, place), and an entry
whose pair has changed since is skipped when it comes up. Words recur, so each worker keeps two
generations of bounded word caches. Decoding concatenates the byte strings of the vocabulary.

Defined cases: null and empty texts have no ids and decode to the empty text; the strings of added tokens in
a text become their ids; texts of any length are encoded whole, in pieces cut only where a word must
end; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

# Fixed value: how byte-level BPE splits words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of these characters only split alike by the standard library, which is faster: ASCII and Latin letters.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"[^\x00-\x1b\x20-\x7e{_LETTERS}]")
PLAIN_PATTERN = re.compile(rf" ?[{_LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]++| ?[^ \t\n\r\f\v0-9{_LETTERS}]++|\s+(?!\S)|\s+")
#: Words in each of the two generations of a worker's cache.
CACHE_WORDS = 400_000
#: Longer words are not cached; longer texts are encoded in pieces of about PIECE characters.
CACHED_LENGTH, PIECE = 64, 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary file, and their bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tokenizer of a vocabulary file (its JSON as bytes)."""

    def __init__(self, spec: bytes):
        import regex

        data = json.loads(spec)
        vocab, symbols = data["model"]["vocab"], byte_symbols()
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.of_byte = [0] * 256
        for char, byte in symbols.items():
            self.of_byte[byte] = vocab[char]
        self.ranks = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.strings[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.any_words = regex.compile(PATTERN).findall
        self.cut = regex.compile(r"\p{L} \p{L}")
        self.young: dict[str, bytes] = _Words(self)
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if PLAIN.search(text) else PLAIN_PATTERN.findall(text)

    def merge(self, ids: list[int]) -> list[int]:
        """ids of a word's bytes, merged by rank, the leftmost of equal ranks first."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r >> 20 << 32 | i for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j == n:
                continue
            r = ranks.get(ids[i] << 20 | ids[j])
            if r is None or r >> 20 != top >> 32:
                continue  # stale
            ids[i] = left = r & 0xFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(left << 20 | ids[k])) is not None:
                    heappush(queue, r >> 20 << 32 | i)
            k = before[i]
            if k >= 0 and (r := ranks.get(ids[k] << 20 | left)) is not None:
                heappush(queue, r >> 20 << 32 | k)
        return [i for i in ids if i >= 0]

    def encode_word(self, word: str) -> bytes:
        of = self.of_byte
        return np.array(self.merge([of[b] for b in word.encode()]), "<u4").tobytes()

    def look_up(self, words: list[str]) -> bytes:
        """The ids of words, one after the other."""
        self.age()
        return b"".join(map(self.young.__getitem__, words))

    def age(self) -> None:
        """Begins a new generation of words when one is full."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, _Words(self)

    def forget(self) -> None:
        self.young, self.old = _Words(self), {}

    def _plain(self, text: str) -> bytes:
        if len(text) <= PIECE:
            return self.look_up(self.words(text))
        parts, at = [], 0
        while at < len(text):
            m = self.cut.search(text, at + PIECE)
            end = m.start() + 1 if m else len(text)
            parts.append(self.look_up(self.words(text[at:end])))
            at = end
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.split_added or not any(t in text for t in self.added):
            return self._plain(text)
        parts = self.split_added.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    """Word to ids; an absent word is looked up in the older generation or encoded."""

    def __init__(self, owner: Bpe):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        found = self.owner.old.get(word) if self.owner.old else None
        if found is None:
            found = self.owner.encode_word(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = found
        return found


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_made: dict[tuple[type, int], Bpe] = {}


def worker_tokenizer(spec: bytes, kind: type = Bpe) -> Bpe:
    """One tokenizer a worker process, made when first asked for."""
    key = (kind, hash(spec))
    if key not in _made:
        _made[key] = kind(spec)
    return _made[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return _mapped(docs, path, id_col, text_col, "ids binary", lambda bpe, text, ids: (ids,), [pa.binary()])


def _digest(bpe: Bpe, text: str, ids: bytes) -> tuple:
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, make, types: list) -> DataFrame:
    common.ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # a vocabulary file: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_tokenizer(spec.value)
        for batch in batches:
            counts, rows = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                rows.append(make(bpe, text, ids))
            own = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c, t) for c, t in zip(own, types, strict=True))], names=["doc_id", "n_tokens", *(c.split()[0] for c in columns.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, {columns}")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text decoded from the ids)."""
    return _mapped(docs, path, id_col, text_col, "ids_sha256 string, decoded_sha256 string", _digest, [pa.string(), pa.string()])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_bpe": op8_bpe}
