"""Byte-level BPE encoding and decoding with a public vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import in_slices, whole_text

# Fixed values of byte-level vocabularies: the pattern that cuts words, and the printable stand-ins of bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHED = 600_000  # words whose ids a worker remembers, in two generations
CACHED_LENGTH = 64
LETTERS_AT_ONCE = 1 << 20  # letters of the texts that are encoded together
IDS_AT_ONCE = 1 << 17  # tokens that are decoded together
NO_RANK = np.int64(2**62)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    spare = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one byte-level vocabulary file.

    ``pair_keys`` holds left and right id of every merge in one integer, sorted; ``ranks`` and ``merged`` go with it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, ids = byte_letters(), content["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = np.array([ids[letter] for letter in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.by_rank = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        first, second = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self.byte_ranks = self.pair_ranks(first.ravel(), second.ravel())  # of all pairs of bytes
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max(chain(ids.values(), self.special.values())) + 1
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(byte_of[letter] for letter in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.token_sizes = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.all_bytes = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.words = regex.compile(WORD_PATTERN).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.packed_special = {token: np.array([i], dtype="<u4").tobytes() for token, i in self.special.items()}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring symbols by binary search over the sorted pairs."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian 32-bit integers.

        All symbols of all words lie in one array beside the rank of the pair that each begins. A round takes the lowest
        rank of each word and joins its occurrences from the left. Ranks stay from round to round; only those of the two
        pairs beside a join are looked up anew. Finished words leave the arrays.
        """
        out: list[bytes] = [b""] * len(words)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.byte_ids[data]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(data), NO_RANK)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.byte_ranks[data[inside].astype(np.int64) << 8 | data[inside + 1]]
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            lowest = np.minimum.reduceat(rank, first)
            over = lowest == NO_RANK
            gone = np.repeat(over, sizes)
            if over.any():
                packed = symbols[gone].astype("<u4").tobytes()
                ends = 4 * np.cumsum(sizes[over])
                for word, start, end in zip(owner[first[over]].tolist(), (ends - 4 * sizes[over]).tolist(), ends.tolist(), strict=True):
                    out[word] = packed[start:end]
            chosen = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~gone)
            if len(chosen):
                # Pairs that overlap are neighbours in a run of one symbol: take every second one of the run.
                run = np.r_[True, chosen[1:] != chosen[:-1] + 1]
                if not run.all():
                    start = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
                    chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
                symbols[chosen] = self.by_rank[rank[chosen]]
                gone[chosen + 1] = True
            kept = np.flatnonzero(~gone)
            moved = np.searchsorted(kept, chosen)
            symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
            beside = np.concatenate([moved, moved - 1])
            beside = beside[beside >= 0]
            rank[beside] = NO_RANK
            beside = beside[beside < len(symbols) - 1]
            beside = beside[owner[beside] == owner[beside + 1]]
            rank[beside] = self.pair_ranks(symbols[beside], symbols[beside + 1])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian 32-bit integers; special tokens in a text keep their id."""
        split: list[list[str]] = []
        for text in texts:
            if any(token in text for token in self.special):
                parts = [(p,) if p in self.special else self.words(p) for p in self.cut.split(text)]
                split.append(list(chain.from_iterable(parts)))
            else:
                split.append(self.words(text))
        if len(self.recent) > CACHED // 2:  # the older half of the cache goes
            self.older, self.recent = self.recent, {}
        known, older = self.recent, self.older
        known.update(self.packed_special)
        found = [list(map(known.get, words)) for words in split]
        missing = {w for words, ids in zip(split, found, strict=True) for w, x in zip(words, ids, strict=True) if x is None}
        kept = missing & older.keys()
        known.update((word, older[word]) for word in kept)
        fresh = list(missing - kept)
        known.update(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
        out = [
            b"".join([x or known[w] for w, x in zip(words, ids, strict=True)]) for words, ids in zip(split, found, strict=True)
        ]
        for word in fresh:  # very long ones are rare and large
            if len(word) > CACHED_LENGTH:
                del known[word]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of any number of texts, a bounded number of letters at once."""
        out: list[bytes] = []
        start = letters = 0
        for i, text in enumerate(texts):
            letters += len(text)
            if letters > LETTERS_AT_ONCE or i == len(texts) - 1:
                out += self.encode(texts[start : i + 1])
                start, letters = i + 1, 0
        return out

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from the table of all tokens."""
        parts = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            part = ids[at : at + IDS_AT_ONCE]
            sizes = self.token_sizes[part]
            ends = np.cumsum(sizes)
            place = np.repeat(self.token_starts[part] - (ends - sizes), sizes)
            place += np.arange(len(place))
            parts.append(self.all_bytes[place].tobytes())
        return b"".join(parts)

    def decode_all(self, packed: list[bytes]) -> Iterator[str]:
        """Text of each packed row of ids; bytes that are no UTF-8 become the replacement character."""
        group: list[bytes] = []
        size = 0
        for i, row in enumerate(packed):
            group.append(row)
            size += len(row)
            if size > 4 * IDS_AT_ONCE or i == len(packed) - 1:
                ids = np.frombuffer(b"".join(group), dtype="<u4")
                data = self.bytes_of(ids)
                ends = np.cumsum(np.r_[0, self.token_sizes[ids]])[np.cumsum([0] + [len(r) // 4 for r in group])].tolist()
                yield from (data[a:b].decode("utf-8", errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True))
                group, size = [], 0

    def decode(self, packed: bytes) -> str:
        return next(self.decode_all([packed]))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(path)


def encoded(text: Column, path: str) -> Column:
    """Binary column of ids, four bytes each."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return in_slices(lambda part: pa.array(vocabulary(path).encode_all(part.to_pylist()), pa.binary()), texts)

    return encode(text)


def decoded(packed: Column, path: str) -> Column:
    """Text column of packed ids."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return in_slices(lambda part: pa.array(vocabulary(path).decode_all(part.to_pylist()), pa.string()), ids)

    return decode(packed)


def coded(text: Column, path: str) -> Column:
    """struct(ids, text): packed ids and what they decode to."""

    @F.arrow_udf("struct<ids:binary,text:string>")
    def code(texts: pa.Array) -> pa.Array:
        return in_slices(round_tripped, texts)

    def round_tripped(texts: pa.Array) -> pa.Array:
        known = vocabulary(path)
        ids = known.encode_all(texts.to_pylist())
        fields = [pa.array(ids, pa.binary()), pa.array(known.decode_all(ids), pa.string())]
        return pa.StructArray.from_arrays(fields, names=["ids", "text"])

    return code(text)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns, with ``bpe_ids`` (packed ids, binary) and ``bpe_text`` (their decoding).

    A null text counts as empty and has no ids. Rows are handled one by one: repeated rows stay, an empty table stays
    empty. Columns of those two names are replaced. ``path`` is a vocabulary file that every worker can read. Arrow
    batches are bounded by Spark's bytes per batch.
    """
    both = docs.withColumn("bpe_ids", coded(whole_text(text), path))
    return both.withColumn("bpe_text", F.col("bpe_ids.text")).withColumn("bpe_ids", F.col("bpe_ids.ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens and digests of ids and decoded text. Ids and texts stay in the worker."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        return in_slices(digested, texts)

    def digested(texts: pa.Array) -> pa.Array:
        known = vocabulary(path)
        ids = known.encode_all(texts.to_pylist())
        sha = lambda data: hashlib.sha256(data).hexdigest()
        fields = [
            pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()),
            pa.array((sha(t.encode()) for t in known.decode_all(ids)), pa.string()),
        ]
        return pa.StructArray.from_arrays(fields, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select("doc_id", digest(whole_text("text")).alias("made"))
    return made.select("doc_id", "made.*")
