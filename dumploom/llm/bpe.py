"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings form a monoid under *join*: the encoding of a concatenation comes from the encodings
of its halves by re-encoding a window around the seam and growing it until its outermost tokens
are stable. Stability is provable: byte pairs merge in order of rank, then of position, so a
token run is the encoding of its bytes exactly if each adjacent pair of tokens encodes to
itself (the first merge across a seam would also happen with only its two tokens present). So
a window may stop where its edge tokens are compatible with the tokens outside.

A text is first cut by the tokenizer's pattern, whose matches never merge; each match is halved
down to leaves of ``LEAF`` bytes and joined up the tree, so a match of any length costs about
linear time. Decoding concatenates token bytes, pairwise up the tree.

Edge cases: null is the empty text (no ids); texts are read whole, very long ones match by match;
without rows there are none; repeated rows each get a row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from functools import lru_cache
from itertools import islice

import regex
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import arrow_map, keeps, named, schema_of

LEAF = 12
DECODED = 4096  # tokens in a leaf of the decoder's tree
MEMO = 24  # bytes of the longest window remembered
CACHE = 400_000  # encoded matches a worker remembers, and a quarter as many of their parts
BLOCK = 200_000  # matches handled at once


class Encoder:
    """``encode_piece`` gives a match's ids; ``encode`` a text's ids as little-endian 32-bit words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache = _Cache(self)
        self._leaves: dict[bytes, list[int]] = {}
        self._compatible: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair is a token."""
        if (known := self._leaves.get(piece)) is not None:
            return known
        rank, none = self.ranks.get, len(self.token)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        ids = [self.ranks[p] for p in parts]
        if len(piece) <= MEMO:
            if len(self._leaves) >= CACHE // 4:
                self._leaves.clear()
            self._leaves[piece] = ids
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` stay as they are when side by side."""
        if (known := self._compatible.get((a, b))) is None:
            if len(self._compatible) > CACHE // 4:
                self._compatible.clear()
            known = self._compatible[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = self.leaf(b"".join(map(self.token.__getitem__, [*left[i:], *right[:j]])))
            left_open = i > 0 and not self.compatible(left[i - 1], window[0])
            right_open = j < len(right) and not self.compatible(window[-1], right[j])
            if not left_open and not right_open:
                return left[:i] + window + right[j:]
            grow = len(left) - i
            i = max(0, i - grow) if left_open else i
            j = min(len(right), 2 * j) if right_open else j

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._tree(piece)

    def _tree(self, piece: bytes) -> list[int]:
        """Halves of leaf size times a power of two, so that parts of equal words coincide; iterative, so any length goes."""
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def blocks(self, text: str):
        """The ids of successive blocks of matches, as little-endian 32-bit words."""
        find = _latin(self.pattern.pattern) if _LATIN.fullmatch(text) else None
        find = find or self.pattern
        if len(text) <= BLOCK:
            yield b"".join(map(self.cache.__getitem__, find.findall(text)))
            return
        matches = (m[0] for m in find.finditer(text))
        while block := list(islice(matches, BLOCK)):
            yield b"".join(map(self.cache.__getitem__, block))

    def encode(self, text: str) -> bytes:
        return b"".join(self.blocks(text))

    def decode(self, ids) -> bytes:
        """Leaves of ``DECODED`` tokens, concatenated in pairs up a tree."""
        token = self.token.__getitem__
        level = [b"".join(map(token, ids[i : i + DECODED])) for i in range(0, len(ids), DECODED)]
        while len(level) > 1:
            level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Cache(dict):
    """match -> its ids as bytes; emptied when full, so memory is bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, match: str) -> bytes:
        packed = b"".join(i.to_bytes(4, "little") for i in self.encoder.encode_piece(match.encode()))
        if len(match) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[match] = packed
        return packed


#: Texts of these characters alone are cut by an equivalent pattern with plain character classes, which is faster.
_LATIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ÿĀ-ſ–—‘’“”…€]*")
_LETTER, _NUMBER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ", "0-9"


@lru_cache(4)
def _latin(pattern: str):
    """``pattern`` with \\p{L} and \\p{N} spelt out for the characters of ``_LATIN``; None if it has other classes."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
    if r"\p" in plain:
        return None
    parts = plain.split("|")  # words first: no other alternative starts like one, and they are the most
    parts.sort(key=lambda x: x not in (f" ?[{_LETTER}]+", f" ?[{_NUMBER}]+"))
    return re.compile("|".join(parts))


@lru_cache(2)
def load(vocabulary: str, pattern: str) -> Encoder:
    """An encoder from a file of base64 tokens and ranks."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids (little-endian 32-bit words).

    ``vocabulary`` is a path that every executor can open; narrow, no shuffle.
    """
    rows = docs.select(*map(named, keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_bpe_text"))

    def encode(batches):
        encoder = load(vocabulary, pattern)
        keeps(__name__, load.cache_clear)
        for batch in batches:
            n, ids_hash, text_hash, packed = [], [], [], []
            for text in batch.column("_bpe_text").to_pylist():
                ids, decoded, count, blocks = hashlib.sha256(), hashlib.sha256(), 0, []
                for block in encoder.blocks(text):
                    words = memoryview(block).cast("I") if sys.byteorder == "little" else [int.from_bytes(block[i : i + 4], "little") for i in range(0, len(block), 4)]
                    ids.update(block)
                    decoded.update(encoder.decode(words))
                    count += len(words)
                    if with_ids:
                        blocks.append(block)
                n.append(count)
                ids_hash.append(ids.hexdigest())
                text_hash.append(decoded.hexdigest())
                packed.append(b"".join(blocks))
            out = {c: batch.column(c) for c in keep} | {"n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}
            yield out | ({"ids": packed} if with_ids else {})

    return arrow_map(rows, encode, schema_of(rows, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
