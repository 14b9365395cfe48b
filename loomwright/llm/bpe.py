"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct words (matches of the pattern) of a large block of the corpus are laid out as one array of byte tokens. An
inverted index lists, for each rank, the positions where the pair of neighbouring tokens there merges to that rank. The
ranks are replayed in order: all positions of the lowest rank merge at once, in every word that has it, and only the
pairs with the new token's two neighbours are looked up again and enter the index. A word's merges depend on that word
alone, so blocks replay independently and what a worker has encoded serves its later blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import mapped

#: Words that a worker keeps encoded, and characters of text in one block.
MOST_WORDS = 250_000
BLOCK_CHARS = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class MergeReplay:
    """The ranks as arrays, and the replay over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in self.tokens] != list(range(len(ranks))):
            raise ValueError("ranks must be consecutive")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(pairs, np.int64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.results = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], -1)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(self.tokens), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of tokens merges to; -1 for none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.results[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int64), sizes
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = -1
        before[(ends - sizes[sizes > 0])] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, -1, np.int64)  # what the pair that begins here merges to
        inside = np.flatnonzero(after >= 0)
        rank[inside] = self.merged(token[inside], token[inside + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            positions = positions[rank[positions] >= 0]
            if not len(positions):
                return
            order = np.argsort(rank[positions], kind="stable")
            positions = positions[order]
            found = rank[positions]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        enter(inside)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[alive[at] & (rank[at] == r)]  # pairs that an earlier merge has changed are out of date
            if not len(at):
                continue
            # Of pairs that overlap only the leftmost merges now: every other one of a chain.
            chained = np.append(False, after[at[:-1]] == at[1:])
            if chained.any():
                place = np.arange(len(at))
                depth = place - np.maximum.accumulate(np.where(chained, 0, place))
                at = at[depth % 2 == 0]
            gone, left = after[at], before[at]
            right = after[gone]
            has_left, has_right = left >= 0, right >= 0
            # What stands left of a merge may itself be the second half of one; then it is that merge's position.
            before_left = np.where(has_left, before[left], -1)
            taken = has_left & np.append(False, (gone[:-1] == left[1:]))
            left = np.where(taken, before_left, left)
            token_right = np.where(has_right, token[right], 0)
            new_right = np.append((right[:-1] == at[1:]), False)
            token_right = np.where(new_right, r, token_right)
            token_left = np.where(taken, r, np.where(has_left, token[left], 0))
            right_rank = np.where(has_right, self.merged(np.full(len(at), r), token_right), -1)
            left_rank = np.where(has_left, self.merged(token_left, np.full(len(at), r)), -1)
            early = ((right_rank >= 0) & (right_rank < r)) | ((left_rank >= 0) & (left_rank < r))
            if early.any():  # a new pair goes before the rest of its word: there only the first one merges now
                first = np.append(True, word[at[1:]] != word[at[:-1]])
                wait = np.isin(word[at], word[at[early]]) & ~first
                if wait.any():
                    enter(at[wait])
                    at = at[~wait]
                    gone, left = after[at], before[at]
                    right = after[gone]
                    has_left, has_right = left >= 0, right >= 0
            token[at] = r
            alive[gone] = False
            rank[gone] = -1
            after[at] = right
            before[right[has_right]] = at[has_right]
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            follows = after[touched]
            rank[touched] = np.where(follows >= 0, self.merged(token[touched], token[follows]), -1)
            enter(touched)
        kept = np.flatnonzero(alive)
        return token[kept], np.bincount(word[kept], minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self.text[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class Encoder:
    """Encodes texts with the words it knows and a replay over those it does not."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MOST_WORDS):
        self.replay, self.find, self.most = MergeReplay(ranks), regex.compile(pattern).findall, most
        self.rows: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.rows, self.ids, self.starts, self.counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        if len(self.rows) > self.most:
            self.clear()
        found = [self.find(text) if text else [] for text in texts]
        fresh = [w for w in dict.fromkeys(w for words in found for w in words) if w not in self.rows]
        if fresh:
            ids, counts = self.replay.encode([w.encode() for w in fresh])
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids.astype(np.int32)])
        out = []
        for words in found:
            row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            counts = self.counts[row]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(row) else 0
            out.append(self.ids[np.repeat(self.starts[row] - (ends - counts), counts) + np.arange(total)])
        return out


ENCODERS: dict[tuple[str, str], Encoder] = {}


def blocks_of(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of the column with about that many characters, and where they begin."""
    block, begin, size = [], 0, 0
    for k, text in enumerate(texts):
        block.append(text.as_py())
        size += len(block[-1] or "")
        if size >= chars:
            yield begin, block
            block, begin, size = [], k + 1, 0
    if block:
        yield begin, block


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs; with_ids adds ids array<int>.

    A null text is encoded as an empty one: no ids, the hashes of empty strings. Repeated rows get equal results; a null
    doc_id stays null; other columns are not read. An empty table gives an empty result. The file of ranks must
    be at the same place on every worker.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def over(batch: pa.RecordBatch) -> Iterator[dict]:
        key = (ranks, pattern)
        if key not in ENCODERS:
            ENCODERS[key] = Encoder(read_ranks(ranks), pattern)
        encoder = ENCODERS[key]
        for begin, block in blocks_of(batch.column(1)):
            encoded = encoder.encode(block)
            out = {
                "doc_id": batch.column(0).slice(begin, len(block)),
                "n_tokens": [len(x) for x in encoded],
                "ids_sha256": [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(encoder.replay.decode(x)).hexdigest() for x in encoded],
            }
            yield out | ({"ids": [x.tolist() for x in encoded]} if with_ids else {})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), over, schema, 10_000)
