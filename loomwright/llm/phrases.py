"""Removal of passages that repeat across documents, by sharded Aho-Corasick automata.

A window is `size` consecutive words. A word goes if it lies in a window whose words also start earlier: in a document
with a smaller doc_id, or earlier in the same one.

1. Candidates. Each window picks one anchor, its smallest hash of ANCHOR words, so equal windows pick equal anchors and
   about one position in eight is an anchor. Spark deals the anchors by hash; those that two different texts hold, or one
   text twice, recur.
2. Confirmation. Only windows with a recurring anchor are dealt by their 96-bit hash. Each window that recurs gets the
   place of its first occurrence, and every shard of documents that holds it is told.
3. Automata. A shard strings its confirmed windows into passages, compiles an Aho-Corasick automaton of
   the passages' pieces of half a window and streams the documents that hold a confirmed window through it. Each hit is extended on the words
   themselves; every occurrence of `size` words or more but the first is removed.

A shard is a hash bucket of documents, so the automata together hold what recurs and each is as small as its shard. Exact
copies are settled beforehand by the hash of the text: a copy loses every word to the first of its group, and neither its
anchors nor its windows count again. A window sends one row for each shard that holds it, whatever its frequency.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from loomwright.llm.common import WORD, joined_groups, kept_rows, mapped, trimmed, words_of

SIZE = 20
ANCHOR = 6
#: Bytes of text in a shard of documents at most, by and large: what one worker holds at once.
SHARD = 20 << 20
BLOCK = re.compile(WORD.encode())
ODD1, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE = 0x8B72E73D5A4E9C4B  # odd, so that its powers have inverses modulo 2 ** 64
POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes hashed at once; a longer text is taken in pieces between words.
PIECE = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS["up"]) < n:
        size = max(1 << 16, 2 * n)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            POWERS[name] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)))
    return POWERS["up"], POWERS["down"]


def hashed(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text: a polynomial of its bytes, from prefix sums over the whole text."""
    raw = text.encode() if text else b""
    if len(raw) > PIECE:
        words = raw.split()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        parts = np.split(np.arange(len(words)), np.searchsorted(ends, np.arange(PIECE, int(ends[-1]) if len(ends) else 0, PIECE)))
        return np.concatenate([prefix_hashes(b" ".join(words[p[0] : p[-1] + 1])) for p in parts if len(p)] or [np.zeros(0, np.uint64)])
    return prefix_hashes(raw)


def prefix_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD2
    return x ^ (x >> np.uint64(29))


def runs_of(hashes: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of every run of `size` consecutive words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * odd + hashes[j : j + n]
    return mixed(out)


def anchors_of(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ANCHOR words, and the position of the anchor of every window."""
    short = runs_of(hashes, ANCHOR, ODD1)
    n = len(hashes) - size + 1
    if n <= 0:
        return short, np.zeros(0, np.int64)
    return short, np.arange(n) + np.lib.stride_tricks.sliding_window_view(short, size - ANCHOR + 1).argmin(1)


def member(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted array, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def recurs(anchors: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """True where the anchor has two texts or more among the rows."""
    order = np.lexsort((texts, anchors))
    a, t = anchors[order], texts[order]
    same = a[1:] == a[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    differs = np.concatenate([[False], same & (t[1:] != t[:-1])])
    out = np.empty(len(a), bool)
    out[order] = np.repeat(np.logical_or.reduceat(differs, starts), np.diff(np.append(starts, len(a))))
    return out


def packed(docs: DataFrame) -> DataFrame:
    """docs with the text compressed on its own, to be dealt."""
    at, schema = docs.columns.index("text"), docs.schema
    schema = StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in schema])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                small = [press(x.as_buffer()) if x.is_valid else None for x in part.column(at)]
                yield part.set_column(at, "text", pa.array(small, pa.binary()))

    return docs.mapInArrow(over, schema)


def unpacked(text: bytes | None) -> str | None:
    return None if text is None else zstandard.decompress(text).decode()


def shard_of(doc_id: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, text_hash, shard) for each text; one that holds an anchor twice sends it under two hashes."""

    def over(batch: pa.RecordBatch):
        found = []
        for text, key, shard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            hashes = hashed(text)
            short, at = anchors_of(hashes, size)
            if len(at):
                anchors, times = np.unique(short[np.unique(at)], return_counts=True)
                twice = anchors[times > 1]
                rows = np.empty((len(anchors) + len(twice), 3), np.int64)
                rows[:, 0] = np.concatenate([anchors, twice]).view(np.int64)
                rows[:, 1], rows[len(anchors) :, 1], rows[:, 2] = key, ~key, shard
                found.append(rows)
        if found:
            anchor, key, shard = np.concatenate(found).T
            again = recurs(anchor, key)
            if again.any():  # known to recur: two marks for each shard stand for all its texts
                pairs = np.unique(np.stack([anchor[again], shard[again]], 1), axis=0)
                once = ~again
                anchor = np.concatenate([anchor[once], pairs[:, 0], pairs[:, 0]])
                key = np.concatenate([key[once], np.zeros(len(pairs), np.int64), np.ones(len(pairs), np.int64)])
                shard = np.concatenate([shard[once], pairs[:, 1], pairs[:, 1]])
            yield {"anchor": anchor, "text_hash": key, "shard": shard}

    return mapped(docs.select("text", "__text", "__shard"), over, "anchor long, text_hash long, shard int", 2048)


def whole_partition(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The columns of a partition, which is one share of a shuffle."""
    got = [b for b in batches if b.num_rows]
    return [np.concatenate([np.asarray(b.column(i)) for b in got]) for i in range(got[0].num_columns)] if got else None


def recurring_anchors(rows: DataFrame) -> DataFrame:
    """(shard, anchor) of the anchors under two text hashes or more."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (columns := whole_partition(batches)) is None:
            return
        anchor, text, shard = columns
        again = recurs(anchor, text)
        out = np.unique(np.stack([anchor[again], shard[again].astype(np.int64)], 1), axis=0)
        for at in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_pydict({"shard": out[at : at + 100_000, 1].astype(np.int32), "anchor": out[at : at + 100_000, 0]})
        del columns, anchor, text, shard, again, out
        trimmed()

    return rows.repartition("anchor").mapInArrow(over, "shard int, anchor long")


def window_rows(docs: DataFrame, told: DataFrame, size: int) -> DataFrame:
    """(window, more, doc_id) of each distinct window with a recurring anchor in a shard, at its first place there.

    more: 32 further bits of hash, 31 of the start, and one that says that the shard holds the window again.
    """
    schema = "window long, more long, doc_id long"

    def over(texts: pa.Table, told: pa.Table) -> pa.Table:
        trimmed()
        kind, key = np.asarray(told.column("kind")), np.asarray(told.column("key"))
        anchors, copies = np.sort(key[kind == 0]).view(np.uint64), set(key[kind == 1].tolist())
        anchors = np.sort(anchors)
        parts = []
        for doc_id, text in zip(texts.column("__doc").to_pylist(), texts.column("text"), strict=True):
            if doc_id in copies or not len(anchors):
                continue
            hashes = hashed(unpacked(text.as_py()))
            short, at = anchors_of(hashes, size)
            starts = np.flatnonzero(member(short, anchors)[0][at])
            if len(starts):
                first, second = runs_of(hashes, size, ODD1)[starts], runs_of(hashes, size, ODD2)[starts]
                parts.append((first.view(np.int64), (second >> np.uint64(32)).astype(np.int64), np.full(len(starts), doc_id), starts))
        if not parts:
            return pa.table({n: pa.array([], pa.int64()) for n in ("window", "more", "doc_id")})
        window, second, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, second, window))
        window, second, doc, start = window[order], second[order], doc[order], start[order]
        new = np.concatenate([[True], (window[1:] != window[:-1]) | (second[1:] != second[:-1])])
        at = np.flatnonzero(new)
        again = np.diff(np.append(at, len(window))) > 1
        # a repeated row of one document is the same place, not a second one
        ends = np.append(at[1:], len(window)) - 1
        again &= (doc[ends] != doc[at]) | (start[ends] != start[at])
        more = (second[at] << 32) | (start[at] << 1) | again
        return pa.table({"window": window[at], "more": more, "doc_id": doc[at]})

    return docs.groupBy("__shard").cogroup(told.groupBy("shard")).applyInArrow(over, schema)


def recurring_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, window, first_doc, first_start): for every row of a window that recurs, the place where it is first."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (columns := whole_partition(batches)) is None:
            return
        window, more, doc = columns
        second, start, again = more >> 32, (more & 0xFFFFFFFF) >> 1, (more & 1).astype(bool)
        order = np.lexsort((start, doc, second, window))
        window, second, doc, start, again = window[order], second[order], doc[order], start[order], again[order]
        new = np.concatenate([[True], (window[1:] != window[:-1]) | (second[1:] != second[:-1])])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(window)))
        recurs = np.repeat((sizes > 1) | np.logical_or.reduceat(again, at), sizes)
        first = np.repeat(at, sizes)[recurs]
        out = {"doc_id": doc[recurs], "window": window[recurs], "first_doc": doc[first], "first_start": start[first]}
        for k in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_pydict({n: x[k : k + 100_000] for n, x in out.items()})
        del columns, window, more, doc, second, start, again, order, recurs, first, out
        trimmed()

    return rows.repartition("window").mapInArrow(over, "doc_id long, window long, first_doc long, first_start long")


def spelled(words: list[bytes]) -> str:
    """Words between single spaces, a character for each byte: an automaton finds whole words only."""
    return (b" %b " % b" ".join(words)).decode("latin-1")


class Passages:
    """The passages of a shard: runs of confirmed windows whose first places also follow one another."""

    def __init__(self, size: int, windows: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray):
        order = np.argsort(windows)
        self.size, self.windows, self.first_doc, self.first_start = size, windows[order], first_doc[order], first_start[order]
        self.seen = np.zeros(len(windows), bool)
        self.found: list[tuple[np.ndarray, int, int]] = []
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        self.step = size // 2  # every window holds one whole piece

    def add(self, text: str | None, words: list[bytes], vocabulary: Vocabulary) -> np.ndarray | None:
        """Adds the passages of a document with windows that none holds yet; its words' numbers if it has a window at all."""
        hit, at = member(runs_of(hashed(text), self.size, ODD1), self.windows)
        if not hit.any():
            return None
        numbers = vocabulary.numbers(words)
        starts = np.flatnonzero(hit)
        at = at[starts]
        fresh = ~self.seen[at]
        starts, at = starts[fresh], at[fresh]
        if len(starts):
            follows = (np.diff(starts) == 1) & (self.first_doc[at[1:]] == self.first_doc[at[:-1]]) & (np.diff(self.first_start[at]) == 1)
            for run in np.split(np.arange(len(starts)), np.flatnonzero(~follows) + 1):
                if self.seen[at[run[0]]] and self.seen[at[run]].all():
                    continue
                self.seen[at[run]] = True
                begin, end = int(starts[run[0]]), int(starts[run[-1]]) + self.size
                number = len(self.found)
                self.found.append((numbers[begin:end], int(self.first_doc[at[run[0]]]), int(self.first_start[at[run[0]]])))
                for k in range(0, end - begin - self.step + 1, self.step):
                    self.pieces.setdefault(spelled(words[begin + k : begin + k + self.step]), []).append((number, k))
        return numbers

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.pieces:
            return None
        out = ahocorasick.Automaton()
        for piece, places in self.pieces.items():
            out.add_word(piece, places)
        out.make_automaton()
        return out

    def reach(self, passage: np.ndarray, offset: int, plain: list[int], last: int) -> int:
        """How many words the hit's alignment has in common around it, as far as one window asks."""
        left, right = offset - 1, offset + self.step
        at, n = last - self.step, self.step
        while left >= 0 and at >= 0 and n < self.size and passage.item(left) == plain[at]:
            left, at, n = left - 1, at - 1, n + 1
        at = last + 1
        while right < len(passage) and at < len(plain) and n < self.size and passage.item(right) == plain[at]:
            right, at, n = right + 1, at + 1, n + 1
        return n

    def removed(self, automaton: ahocorasick.Automaton, words: list[bytes], numbers: np.ndarray, doc_id: int) -> np.ndarray | None:
        """True for every word of the document to remove; None for none."""
        out, tried, n, plain = None, set(), len(numbers), numbers.tolist()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1).tolist()
        for end, places in automaton.iter(spelled(words)):
            last = bisect_left(ends, end)
            for number, offset in places:
                origin = last - self.step + 1 - offset  # where the passage would begin in this document
                passage, first_doc, first_start = self.found[number]
                if (number, origin) in tried or first_doc == doc_id and first_start == origin:
                    continue
                if self.reach(passage, offset, plain, last) < self.size:
                    continue
                tried.add((number, origin))
                begin, stop = max(0, origin), min(n, origin + len(passage))
                if out is not None and out.find(0, begin, stop) < 0:
                    continue
                differs = np.flatnonzero(numbers[begin:stop] != passage[begin - origin : stop - origin])
                edges = np.concatenate([[-1], differs, [stop - begin]])
                for k in np.flatnonzero(np.diff(edges) > self.size).tolist():
                    out = bytearray(n) if out is None else out
                    out[begin + edges[k] + 1 : begin + edges[k + 1]] = b"\1" * int(edges[k + 1] - edges[k] - 1)
        return None if out is None else np.frombuffer(out, bool)


def cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone and the white space after each."""
    raw = text.encode()
    starts = np.array([m.start() for m in BLOCK.finditer(raw)] + [len(raw)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept, at = [], 0
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        kept.append(raw[at : starts[begin]])
        at = int(starts[end])
    return b"".join([*kept, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs, all columns, with n_words, n_removed, kept_sha256 and kept_text; columns with those names are replaced.

    kept_text is the text without the removed words; kept_sha256 is of the kept words joined by one space. A null text has
    no words and stays null. Texts shorter than a window lose nothing. Of equal texts the one with the smallest doc_id
    counts as first. Rows that share a doc_id are one document; a null doc_id comes before all others. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    columns = docs.columns
    keyed = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__shard", shard_of("__doc", shards))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = keyed.select("__doc", digest.alias("digest"))
    groups = texts.groupBy("digest").agg(F.min("__doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = kept_rows(joined_groups(texts, groups, "digest", "n").where("__doc > least").select(shard_of("__doc", shards).alias("shard"), F.lit(1).alias("kind"), F.col("__doc").alias("key")))
    blank = [F.lit(0).cast("long").alias("first_doc"), F.lit(0).cast("long").alias("first_start")]
    anchors = recurring_anchors(anchor_rows(keyed.withColumn("__text", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")), size))
    told = copies.union(anchors.select("shard", F.lit(0), "anchor"))
    windows = recurring_windows(window_rows(packed(keyed.select("__doc", "text", "__shard")), told, size))
    confirmed = windows.select(shard_of("doc_id", shards).alias("shard"), F.lit(2).alias("kind"), F.col("window").alias("key"), "first_doc", "first_start")
    told = copies.select("*", *blank).union(confirmed)
    extra = "n_words long, n_removed long, kept_sha256 string, kept_text string"
    schema = spark.createDataFrame([], docs.schema).selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (x.split() for x in extra.split(", "))]).schema
    arrow = to_arrow_schema(schema)

    def over(texts: pa.Table, told: pa.Table) -> pa.Table:
        trimmed()  # what the shard before has freed
        if not texts.num_rows:
            return arrow.empty_table()
        kind, key = np.asarray(told.column("kind")), np.asarray(told.column("key"))
        copies, sure = set(key[kind == 1].tolist()), kind == 2
        passages = Passages(size, key[sure].view(np.uint64), np.asarray(told.column("first_doc"))[sure], np.asarray(told.column("first_start"))[sure])
        vocabulary = Vocabulary()
        ids, plain = texts.column("__doc").to_pylist(), [unpacked(x.as_py()) for x in texts.column("text")]
        out, hits = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "kept_text")}, []
        for k, (doc_id, text) in enumerate(zip(ids, plain, strict=True)):
            words = words_of(text)
            whole = doc_id in copies and len(words) >= size
            if doc_id not in copies and len(passages.windows):
                numbers = passages.add(text, words, vocabulary)
                if numbers is not None:
                    hits.append((k, numbers))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) if whole else 0)
            out["kept_sha256"].append(hashlib.sha256(b"" if whole else b" ".join(words)).hexdigest())
            out["kept_text"].append(cut(text, np.ones(len(words), bool)) if whole else text)
        automaton = passages.automaton()
        for k, numbers in hits:  # a document without a confirmed window has no occurrence
            words = words_of(plain[k])
            gone = passages.removed(automaton, words, numbers, ids[k])
            if gone is not None:
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out["n_removed"][k] = len(words) - len(kept)
                out["kept_sha256"][k] = hashlib.sha256(b" ".join(kept)).hexdigest()
                out["kept_text"][k] = cut(plain[k], gone)
        texts = texts.set_column(texts.column_names.index("text"), "text", pa.array(plain, pa.string()))
        arrays = [pc.cast(texts.column(c), arrow.field(c).type) for c in columns] + [pa.array(out[c], arrow.field(c).type) for c in out]
        return pa.Table.from_arrays(arrays, schema=arrow)

    return packed(keyed).groupBy("__shard").cogroup(told.groupBy("shard")).applyInArrow(over, schema)
