"""A language model by online logistic context mixing over the words of a corpus.

A text is its words (A-Z lower-cased) and an end mark. Each token is a path of binary choices in a Huffman tree. Its leaves
are the ALPHABET most frequent words that training saw twice or more, and classes by shape for all other words. Four
predictors give the odds of a choice, from counts of training tokens: the tree alone; the last frequent word before; the
word before; and the two words before, each as a hash. A predictor falls back on the one before it where it has seen
little. Their log odds are mixed by weights, one set for each gate (how much the contexts have seen, whether the longest
was ever undecided, the depth in the tree), that move after every batch of choices. An adaptive map from gate and mixed
odds to the share of choices that came true refines the result. The text's own words so far are mixed in last.

A word outside the alphabet is named within its class by an absolute discount on its training count; the class keeps one
share for whatever training never saw, as the base's formula does, so that both scores weigh the same events. Where the
text repeats such a word, its path is known to one lane and its name to another: both go to the document, which mixes in the
text's own share there, by the same formula as for words of the alphabet. Bits per
byte count the spelling of unseen words as well, by a table of two bytes of context.

What is gathered grows with the corpus: every token of every text is one event, dealt by the hash of the word before it to
one of N / LANE lanes (N: training tokens), so that a lane holds all that followed its words. A word that is followed more
than LANE / PARTS times is dealt to several lanes: by the word before it, or by document where that is as frequent. A lane's
words fall into PARTS parts by their hash. All counts are of the whole corpus. A context that one lane alone holds is counted
there, in arrays sorted by context and code. For the others (the last frequent word, by part; words and pairs that are dealt
to several lanes) each lane sends its counts to a task for the context, which adds them up and answers with the sums along
the paths that the lane asked for. A part mixes its events in the order of a hash, by weights of its own: what it computes is
a function of the corpus, not of partitions, batches or machines. Batches are cut by the events that are learnt
from, and the others among them are scored first: no score depends on held-out documents but their own. A training document
is scored without one occurrence of each of its own events, as a text that training never saw would be.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import held_out, stored

#: Parameters of the model: words with a leaf of their own, words that count as frequent, training tokens of a lane, and
#: parts of a lane, by the word before, that are counted and mixed one after another.
ALPHABET, FREQUENT, LANE, PARTS = 200_000, 255, 1_000_000, 4
CLASSES, DISCOUNT = 32, 0.75
END = b"\n"  # no word holds a line feed
#: Weight of what a predictor falls back on, and where the weights of the predictors begin.
BACK, START = (2.0, 1.0, 0.5), (0.1, 0.2, 0.3, 0.4)
GATES, BINS, REACH, PRIOR = 4 * 4 * 2 * 4, 32, 12.0, 16.0
#: Events in a batch of the mixer: batches double from the first size to the last.
FIRST, LAST, RATE = 256, 8192, 0.25
#: What a text's own words are trusted with at most, after how many of them half of it, and the steps in which it is sent.
TRUST, LAG, SHARES = 0.3, 50, 15
#: Bytes and texts handled at once, and bytes whose words are counted at once.
BLOCK_BYTES, BLOCK_TEXTS, COUNT_BYTES = 2 << 20, 1 << 16, 16 << 20
#: Events whose choices are computed at once: their arrays stay in a processor's cache.
CHUNK = 4096
#: Remainders of the ids that are noted as those of repeated ids.
REPEATED = 1 << 20
#: Tasks for each kind of context that add up what several lanes have counted.
TASKS = 256
#: What a gate adds up: how much the word before has seen, how much both have, the depth; and 4 where both were undecided.
CENTRES = 1 / (1 + np.exp(-(np.arange(BINS + 1) / BINS * 2 - 1) * REACH))
#: The share at each place of a text; it stays what it is at the last of these places.
SHARE_AT = (SHARES * np.arange(LAG * SHARES) // (np.arange(LAG * SHARES) + LAG)).astype(np.uint8)
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EDGE = np.uint64(0x5851F42D4C957F2D)  # stands for the words before a text
#: What the bytes of a word tell of its class: 1 not a letter, 2 not ASCII, 4 a digit.
TELLS = np.array([(not bytes([b]).isalpha()) + 2 * (b > 127) + 4 * (48 <= b < 58) for b in range(256)], np.uint8)
KINDS = np.array([0 if not t & 1 else 1 if t & 2 else 2 if t & 4 else 3 for t in range(8)], np.int64)
SPELLED = 64 * 64 * 256
#: Bits of a leaf's rank, after a context, in a key; marks beside an event's share: its word before, and its pair, are in several lanes.
RANK, SPLIT, SPLIT_PAIR = np.uint64(18), 16, 32
PAIR = np.uint32((1 << 24) - 1)  # bits of the hash of two words before
HASHED = np.uint64(1 << 24)  # above all leaves: added to such a hash where it is sent instead of them


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, none for null, and all of them, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    found, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    some = pc.greater(pc.binary_length(found), 0)  # a text that begins or ends with a space has an empty word there
    before = np.append(0, np.cumsum(np.asarray(some.cast(pa.int8())), dtype=np.int64))
    return np.diff(before[ends - ends[0]]), found.filter(some)


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words one after another, and the length of each."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], np.diff(offsets)


def strings_of(words: pa.Array) -> list[bytes]:
    """Words one by one; none of them holds the mark that joins them on the way."""
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)]), words.cast(pa.large_binary()))
    return pc.binary_join(whole, pa.scalar(END, pa.large_binary()))[0].as_py().split(END) if len(words) else []


def shapes_of(words: pa.Array) -> np.ndarray:
    """The class of each word by its length and kind of characters; no word is empty."""
    raw, sizes = flat(words)
    if not len(sizes):
        return sizes
    return KINDS[np.bitwise_or.reduceat(TELLS[raw], np.cumsum(sizes) - sizes)] * 8 + np.minimum(7, np.frexp(sizes)[1])


def shape(word: bytes) -> int:
    return int(shapes_of(pa.array([word]))[0])


def blocks(batches: Iterator[pa.RecordBatch], size: int, texts: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of about `size` bytes of their column text, and at most so many rows."""
    held, waiting, rows = [], 0, 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = min(at + int(np.searchsorted(np.cumsum(sizes[at:]), size - waiting)) + 1, at + texts - rows, batch.num_rows)
            held.append(batch.slice(at, end - at))
            waiting, rows, at = waiting + int(sizes[at:end].sum()), rows + end - at, end
            if waiting >= size or rows == texts:
                yield pa.Table.from_batches(held)
                held, waiting, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def word_counts(docs: DataFrame, modulus: int) -> DataFrame:
    """(word, seen): every distinct word of training documents and the end mark, with its occurrences there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, COUNT_BYTES, COUNT_BYTES):
            counts = words_in(block.column("text").combine_chunks())[1].value_counts()
            words = pa.concat_arrays([counts.field(0).cast(pa.string()), pa.array([END.decode()])])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(counts.field(1), block.num_rows))], names=["word", "seen"])

    rows = docs.where(~held_out("doc_id", modulus)).select("text").mapInArrow(over, "word string, seen long")
    return rows.groupBy("word").agg(F.sum("seen").alias("seen"))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes, left-aligned in 64 bits, and their lengths."""
    n = len(counts)
    heap = list(zip(np.maximum(counts, 0.5).tolist(), range(n), strict=True))
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    length = depth[:n]
    if length.max() > 52:
        raise ValueError("a code is longer than 52 bits")
    order = np.lexsort((np.arange(n), length))
    code = np.zeros(n, np.uint64)
    steps = np.uint64(1) << (64 - length[order]).astype(np.uint64)
    code[order[1:]] = np.cumsum(steps[:-1], dtype=np.uint64)
    return code, length


def prefix_weights(order: np.ndarray, context: np.ndarray, code: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row, length + 1 sums one after another: the weight of the rows with its context and the first d bits of its code.

    order: of the rows by context, then code.
    """
    n = len(code)
    out = np.repeat(weight.astype(np.float32), length + 1)
    if not n:
        return out
    c, k, size = context[order], code[order], length[order]
    common = np.full(n, -1, np.int16)  # bits in common with the row before, in the same context
    common[1:] = np.where(c[1:] == c[:-1], 52 - np.frexp(((k[1:] ^ k[:-1]) >> np.uint64(12)).astype(float))[1], -1)
    w, place = weight[order], (np.cumsum(length + 1, dtype=np.int64) - (length + 1))[order]
    for d in range(int(length.max()) + 1):
        new = common < d
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(w, starts, dtype=float).astype(np.float32)
        out[place + d] = sums[np.cumsum(new) - 1]
        # a row alone in its group has its own weight from here on, as out has from the start
        live = (size > d) & ~(new & np.append(new[1:], True))
        common, size, w, place = common[live], size[live], w[live], place[live]
        if not len(place):
            break
        common[0] = -1
    return out


@dataclass
class Model:
    """words: the alphabet, most frequent first; seen: their counts; classes: tokens and types of the others by class.

    repeated: for each remainder of doc_id, whether it may be that of an id that several rows have; None: any may.
    """

    words: list[bytes]
    seen: np.ndarray
    classes: np.ndarray
    spelling: np.ndarray
    tokens: int
    types: int
    lanes: int
    lane: int
    repeated: np.ndarray | None = None

    def prepare(self) -> Model:
        if len(self.words) + CLASSES > 1 << 18:
            raise ValueError("an alphabet has less than 2 ** 18 words")
        counts = np.concatenate([self.seen, self.classes[0]]).astype(float)
        self.code, self.length = huffman(counts)
        order = np.argsort(self.code)
        self.by_rank, self.codes = order, self.code[order]
        self.rank = np.empty(len(order), np.uint64)
        self.rank[order] = np.arange(len(order))
        self.tree = prefix_weights(order, np.zeros(len(counts), np.int8), self.code, self.length, np.maximum(counts, 0.5))
        self.tree_at = np.cumsum(self.length + 1) - (self.length + 1)
        digests = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.words), np.uint64, len(self.words))
        self.hashes = np.append(digests, EDGE)
        return self

    def base(self, seen: np.ndarray) -> np.ndarray:
        return np.log10((seen + 1) / (self.tokens + self.types + 1))

    def named(self, shapes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """log10 of a word's share in its class: by its count, or of all that was never seen."""
        tokens, types = self.classes[0][shapes], self.classes[1][shapes]
        share = np.where(seen > 0, seen - DISCOUNT, DISCOUNT * types) / np.maximum(tokens, 1)
        return np.log10(np.where(tokens > 0, np.maximum(share, 1e-12), 1.0))

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's bytes and a closing space."""
        if not words:
            return np.zeros(0)
        keys, owner = spelling_keys(words)
        return np.bincount(owner, self.spelling[keys], len(words))


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(two bytes before, byte) of every byte of the words and their closing spaces, and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    one[1:], two[2:] = raw[:-1] & 63, raw[:-2] & 63
    return (np.where(place > 1, two, 0) * 64 + np.where(place > 0, one, 0)) * 256 + raw, owner


def spelling_table(counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of a byte after two others: orders 2, 1 and 0, each falling back on the next."""
    table = counts.reshape(64, 64, 256)
    p = np.full(256, 1 / 256)
    for part in (table.sum((0, 1)), table.sum(0), table):
        p = (part + 4 * p) / (part.sum(-1, keepdims=True) + 4)
    return np.log10(p).ravel().astype(np.float32)


def fit(words: DataFrame, alphabet: int = ALPHABET, lane: int = LANE) -> Model:
    """The parts of the model with a size of their own, from the table (word, seen): the alphabet, classes and spelling."""
    n, v = (x or 0 for x in words.agg(F.sum("seen"), F.count_if(F.col("seen") > 0)).first())
    top = words.where("seen > 1").orderBy(F.desc("seen"), "word").limit(alphabet).select("word", "seen").toArrow()
    names, seen = top.column(0).cast(pa.binary()).to_pylist(), np.asarray(top.column(1)).astype(np.int64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(SPELLED + 2 * CLASSES)
        for batch in batches:
            some, shapes = batch.column(0).cast(pa.binary()).to_pylist(), shapes_of(batch.column(0))
            totals[SPELLED : SPELLED + CLASSES] += np.bincount(shapes, np.asarray(batch.column(1)), CLASSES)
            totals[SPELLED + CLASSES :] += np.bincount(shapes, minlength=CLASSES)
            if some:
                totals[:SPELLED] += np.bincount(spelling_keys(some)[0], minlength=SPELLED)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"i": at, "n": totals[at]})

    sums = outside(words, names, seen).where("seen > 0").select("word", "seen").mapInArrow(over, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(SPELLED + 2 * CLASSES)
    totals[np.asarray(sums.column(0))] = np.asarray(sums.column(1))
    return Model(names, seen, totals[SPELLED:].reshape(2, CLASSES), spelling_table(totals[:SPELLED]), n, v, max(1, -(-n // lane)), lane)


def outside(words: DataFrame, names: list[bytes], seen: np.ndarray) -> DataFrame:
    """The rows of words after the last one of the alphabet, in the order that chose it."""
    if not names:
        return words
    last, least = names[-1].decode(), int(seen[-1])
    return words.where((F.col("seen") < least) | ((F.col("seen") == least) & (F.col("word") > last)))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as the planes of their bytes, compressed."""
    n = len(arrays[0])
    out = np.empty((sum(a.itemsize for a in arrays), n), np.uint8)
    at = 0
    for a in arrays:
        each = np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize)
        for k in range(a.itemsize):
            out[at] = each[:, k]
            at += 1
    return zstandard.compress(out, 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        each = np.empty((n, size), np.uint8)
        for k in range(size):
            each[:, k] = raw[at : at + n]
            at += n
        out.append(each.view(kind).ravel())
    return out


def coarse(own: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the text's own words are given, in tenths of an octave, and their share of the belief, in SHARES steps: rounded down."""
    steps = np.where(own > 0, np.minimum(255, 1 + np.ceil(-10 * np.log2(np.maximum(own, 1e-30) / TRUST) - 1e-9)), 0)
    return steps.astype(np.uint8), share.astype(np.uint8)


def fine(steps: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(steps > 0, TRUST * 2.0 ** ((1.0 - steps) / 10), 0), parts * (TRUST / SHARES)


def mixed_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD2
    return x ^ (x >> np.uint64(31))


class Reader:
    """Turns texts into events; what it needs of the model is made once in a worker."""

    def __init__(self, model: Model):
        self.model = model
        head = len(model.words)
        self.find = dict(zip(model.words, range(head), strict=True))
        self.end = self.find.get(END, head + shape(END))
        self.base = np.append(model.base(model.seen), 0.0)
        self.parts = np.concatenate([-(-model.seen * PARTS // model.lane), np.ones(CLASSES, np.int64)]).astype(np.uint64)
        self.first_parts = self.parts[self.find.get(END, -1)]  # the mark before a text is followed as often as texts end

    def block(self, doc_ids: list[int | None], digests: np.ndarray, held: np.ndarray, texts: list[str | None] | pa.Array) -> Iterator[tuple]:
        """(lane, kind, docs, data, words): the pieces of a block, by lane; kind 0 events, 1 words outside the alphabet, 2 documents.

        A null doc_id is the hash of its text. An event's words before it are leaves, in the order of the alphabet, where
        they have one, and otherwise hashes, above all leaves.
        """
        model, head = self.model, len(self.model.words)
        sizes, every = words_in(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        sizes += 1
        n = int(sizes.sum())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        start = np.cumsum(sizes) - sizes
        i = np.arange(n) - start[doc]
        ends = start + sizes - 1
        null = np.array([d is None for d in doc_ids], bool)
        ids = np.array([g if d is None else d for d, g in zip(doc_ids, digests.tolist(), strict=True)], np.int64)
        again = ~null if model.repeated is None else ~null & model.repeated[ids & (REPEATED - 1)]
        digests = digests.astype(np.uint32)

        # the distinct words of the block, the end mark last, and which is every token's
        coded = every.dictionary_encode()
        listed = coded.dictionary.cast(pa.large_binary())
        strings = [*strings_of(listed), END]
        code = np.empty(n, np.int64)
        code[ends] = len(strings) - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        code[inner] = np.asarray(coded.indices)
        found = np.fromiter(map(self.find.get, strings, [-1] * len(strings)), np.int64, len(strings))
        strange = np.flatnonzero(found < 0)
        found[-1] = self.end
        leaf_of, hash_of = found.copy(), model.hashes[np.minimum(found, head)]
        inside = strange[strange < len(strings) - 1]
        leaf_of[inside] = head + shapes_of(listed.take(pa.array(inside)))
        hash_of[strange] = np.fromiter((xxhash.xxh64_intdigest(strings[k], 42) for k in strange.tolist()), np.uint64, len(strange))
        size_of = np.append(flat(listed)[1], len(END))
        known_of = leaf_of < head

        leaf, words, known = leaf_of[code], hash_of[code], known_of[code]
        base = np.bincount(doc, self.base[np.minimum(leaf_of, head)][code], len(sizes))
        about = (base, np.bincount(doc, known, len(sizes)).astype(np.int64), sizes, np.bincount(doc, size_of[code], len(sizes)).astype(np.int64) + sizes - 1)

        label = np.zeros(n, np.uint32)
        group, order = sorted_keys(doc * len(strings) + code, n)
        new = np.append(True, group[1:] != group[:-1])
        times = np.empty(n, np.int64)
        times[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rare = np.flatnonzero(~known)
        once_more = rare[times[rare] > 0]
        label[once_more] = labels(words[once_more])
        share = SHARE_AT.take(i, mode="clip")
        own, some = np.zeros(n, np.uint8), np.flatnonzero(times)
        own[some], _ = coarse(share[some] * (TRUST / SHARES) * times[some] / i[some], share[some])

        first, early = start, np.concatenate([start, start[sizes > 1] + 1])
        before, second = np.append(EDGE, words[:-1]), np.concatenate([[EDGE, EDGE], words])[:n]
        before[first] = EDGE
        second[early] = EDGE
        frequent = np.where(leaf < min(FREQUENT, head), np.arange(n), -1)
        last = np.append(-1, np.maximum.accumulate(frequent)[:-1])
        company = np.where((last >= start[doc]) & (i > 0), leaf[np.maximum(last, 0)], FREQUENT)
        salt = mixed_hash(ids.view(np.uint64) * ODD + EDGE)
        parts = np.append(self.first_parts, self.parts[leaf_of][code[:-1]])
        parts[first] = self.first_parts
        parts_before = np.append(self.first_parts, parts[:-1])
        parts_before[first] = self.first_parts
        pair = (parts > 1) & (parts_before > 1)
        share = share | (SPLIT * (parts > 1) + SPLIT_PAIR * pair).astype(np.uint8)
        dealt = np.zeros(n, np.uint64)
        some = np.flatnonzero(parts > 1)
        dealt[some] = np.where(pair[some], salt[doc[some]], mixed_hash(second[some] + ODD)) % parts[some]
        lane = mixed_hash(before + dealt * ODD)
        lane = (lane - lane // np.uint64(model.lanes) * np.uint64(model.lanes)).astype(np.int64)
        one, two = (x >> np.uint64(40) for x in (before, mixed_hash(before + second * ODD)))
        place = np.where(known_of, leaf_of, -1)[code]
        place_one, place_two = np.append(head, place[:-1]), np.concatenate([[head, head], place])[:n]
        place_one[first] = head
        place_two[early] = head
        two = np.where((place_one < 0) | (place_two < 0), two + HASHED, place_two.view(np.uint64)).astype(np.uint32)
        one = np.where(place_one < 0, one + HASHED, place_one.view(np.uint64)).astype(np.uint32)

        def documents(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
            some = np.zeros(len(sizes), np.int64)
            some[rows] = 1
            used, at = np.flatnonzero(some), (np.cumsum(some) - 1)[rows]
            return at, packed(np.diff(ids[used], prepend=0), digests[used], (held[used] + 2 * null[used] + 4 * again[used]).astype(np.uint8))

        at = sorted_keys(lane << 25 | one, n)[1]
        by_lane = [x[at] for x in (doc, one, two, leaf.astype(np.uint32), company.astype(np.uint8), own, share, label)]
        lane = lane[at]
        cuts = [0, *(np.flatnonzero(np.diff(lane)) + 1).tolist(), n] if n else [0]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            rows, ones, *rest = (x[low:high] for x in by_lane)
            row, docs = documents(rows)
            yield int(lane[low]), 0, docs, packed(row.astype(np.uint16), np.diff(ones, prepend=np.uint32(0)), *rest), b""
        if len(rare):
            pairs, counts = np.unique(code[rare] * len(sizes) + doc[rare], return_counts=True)
            word, row = pairs // len(sizes), pairs % len(sizes)
            lane = (hash_of.view(np.int64) % model.lanes)[word]
            at = np.argsort(lane, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(lane[at])) + 1):
                rows, docs = documents(row[part])
                yield int(lane[part[0]]), 1, docs, packed(rows.astype(np.uint16), counts[part].astype(np.uint32)), zstandard.compress(b" ".join(strings[k] for k in word[part].tolist()), 1)
        row, docs = documents(np.arange(len(sizes)))
        yield int(salt[0] % np.uint64(model.lanes)), 2, docs, packed(*about), b""


def sorted_places(keys: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind=kind)
    return keys[order], order


def sorted_keys(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, none below 0, in ascending order, and the places from which they come; equal ones in the order of their places."""
    bits = int(n).bit_length()
    if n and int(keys.max()) >> (63 - bits):
        return sorted_places(keys, "stable")
    both = np.sort(keys << bits | np.arange(n))
    return both >> bits, both & ((1 << bits) - 1)


def labels(hashes: np.ndarray) -> np.ndarray:
    """What tells a document's words outside the alphabet apart, from their hashes; never 0."""
    return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@dataclass
class Mixer:
    """The weights of the predictors by gate, and the map that refines their odds; both move with what they see."""

    weights: np.ndarray
    came_true: np.ndarray
    steps: int = 0

    @classmethod
    def new(cls) -> Mixer:
        return cls(np.repeat(np.array(START, np.float32)[:, None], GATES, 1), np.zeros((GATES, BINS + 1)))

    def __post_init__(self) -> None:
        self.begin()

    def begin(self) -> None:
        """What follows is a new batch: nothing of it has been seen."""
        self.slopes, self.near = np.zeros((len(self.weights) + 1, GATES)), np.zeros(self.came_true.size)
        self.share = ((self.came_true + PRIOR * CENTRES) / (self.came_true + self.came_true[:, ::-1] + PRIOR)).astype(np.float32).ravel()

    def log10(self, x: np.ndarray, gates: np.ndarray, learns: np.ndarray) -> np.ndarray:
        """log10 of the probability of each choice made, whose log odds are the rows of x; then learns from the choices marked."""
        logs = self.choices(x, gates, np.flatnonzero(~learns))
        if learns.any():
            self.learn()
        return logs

    def choices(self, x: np.ndarray, gates: np.ndarray, skipped: np.ndarray | None) -> np.ndarray:
        """log10() of some choices of a batch; what learn() takes from them, but for those skipped (None: all), is added up."""
        total, term = np.zeros(len(gates), np.float32), np.empty(len(gates), np.float32)
        for weights, part in zip(self.weights, x, strict=True):
            np.take(weights, gates, out=term, mode="clip")
            term *= part
            total += term
        np.clip(total, np.float32(-REACH), np.float32(REACH), out=total)
        p = np.exp(-total)
        p += 1
        np.divide(1, p, out=p)
        total += np.float32(REACH)
        total *= np.float32(BINS / 2 / REACH)
        low = np.minimum(total.astype(np.int64), BINS - 1)
        total -= low
        low += gates * (BINS + 1)
        logs = self.share.take(low, mode="clip")
        low += 1
        above = self.share.take(low, mode="clip")
        above -= logs
        above *= total
        logs += above
        logs += p
        logs *= np.float32(0.5)
        np.maximum(logs, np.float32(2.0**-30), out=logs)
        np.log(logs, out=logs)
        logs *= np.float32(1 / np.log(10))
        if skipped is not None:
            error = 1 - p
            error[skipped] = 0
            p *= error
            p *= np.einsum("ij,ij->j", x, x)
            self.slopes[-1] += np.bincount(gates, p, GATES)
            for slope, part in zip(self.slopes, x, strict=False):
                slope += np.bincount(gates, np.multiply(error, part, out=term), GATES)
            low -= total <= 0.5
            low[skipped] = len(self.near)
            self.near += np.bincount(low, minlength=len(self.near) + 1)[: len(self.near)]
        return logs

    def learn(self) -> None:
        *slopes, curve = self.slopes
        size = curve + 0.05 * curve.sum() / GATES + 1e-9
        rate = RATE / (1 + self.steps / 100)
        for k, slope in enumerate(slopes):
            self.weights[k] += (rate * slope / size).astype(np.float32)
        self.came_true += self.near.reshape(self.came_true.shape)
        self.steps += 1
        self.begin()


#: Counts along a path whose nodes have all the same one: 64 times 0, 64 times 1, and so on.
EVEN = np.repeat(np.arange(256, dtype=np.float32), 64)
LIMITS = np.array([1e-6, 1 - 1e-6], np.float32).view(np.int32)


def odds(p: np.ndarray) -> np.ndarray:
    bits = np.clip(p.view(np.int32), *LIMITS)  # numbers above 0 are in the order of their bits, which are compared faster
    p = bits.view(np.float32)
    rest = 1 - p
    np.divide(p, rest, out=p)
    return np.log(p, out=p)


def contexts(one: np.ndarray, two: np.ndarray, company: np.ndarray, share: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The three contexts of events of one part, and which events have it in lanes besides their own."""
    part = one.astype(np.uint64) % np.uint64(PARTS)
    word = one.astype(np.uint64)
    return [
        (part << np.uint64(8) | company, np.ones(len(one), bool)),
        (word, share & SPLIT > 0),
        (word << np.uint64(22) | (two & np.uint32((1 << 22) - 1)), share & SPLIT_PAIR > 0),
    ]


def distinct_rows(model: Model, context: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of context and leaf as sorted keys, the weight of each, and which is every row's."""
    key = context << RANK | model.rank[leaf]
    fits = len(key) and int(key.max()) >> (63 - len(key).bit_length()) == 0
    key, order = sorted_keys(key.view(np.int64), len(key)) if fits else sorted_places(key)
    key = key.view(np.uint64)
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return key[new], np.bincount(which, weight, int(new.sum())).astype(np.float32), which


def by_task(key: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by the tasks that count their contexts, and the task of each in that order."""
    task = (mixed_hash((key >> RANK) * ODD + EDGE) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    return order, task[order]


def turns(model: Model, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length of the keys' leaves, and the bits in common with the key before: -1 where its context differs."""
    leaf = model.by_rank[(key & ((np.uint64(1) << RANK) - np.uint64(1))).astype(np.int64)]
    code, length, common = model.code[leaf], model.length[leaf], np.full(len(key), -1, np.int64)
    context = key >> RANK
    common[1:] = np.where(context[1:] == context[:-1], 52 - np.frexp(((code[1:] ^ code[:-1]) >> np.uint64(12)).astype(float))[1], -1)
    return code, length, common


def whole_counts(model: Model, requests: pa.Table) -> pa.Table:
    """(lane, who, task, data): for every list of keys the counts of all lists below each node of the keys' paths.

    The nodes of a key follow from its first one that is not on the path of the key before.
    """
    lists = [unpacked(data.as_py(), "u8", "u4") for data in requests.column("data")]
    keys = [np.cumsum(delta, dtype=np.uint64) for delta, _ in lists]
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(new) - 1
    weight = np.add.reduceat(np.concatenate([n for _, n in lists])[order], np.flatnonzero(new), dtype=np.int64)
    every = every[new]
    code, length, _ = turns(model, every)
    sums = prefix_weights(np.arange(len(every)), every >> RANK, code, length.astype(np.int16), weight)
    begin = np.cumsum(length + 1) - (length + 1)
    replies, at = [], 0
    for key in keys:
        rows = which[at : at + len(key)]
        _, size, common = turns(model, key)
        n = size - common
        count = sums.take(np.arange(int(n.sum())) + np.repeat(begin[rows] + common + 1 - (np.cumsum(n) - n), n)).astype(np.int64)
        replies.append(packed(steps_down(np.minimum(count, 2**32 - 1), n)))
        at += len(key)
    who = requests.column("who")
    return pa.table({"lane": pa.array(np.asarray(who) // PARTS, pa.int32()), "who": who, "task": requests.column("task"), "data": pa.array(replies, pa.binary())})


def steps_down(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts along paths, n of each: the first of every path, then by how much each is less than the one before."""
    out = np.append(0, count[:-1]) - count
    first = (np.cumsum(n) - n)[n > 0]
    out[first] = count[first]
    return out.astype(np.uint32)


def counts_of(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What steps_down() was given."""
    out = -steps.astype(np.int64)
    first = (np.cumsum(n) - n)[n > 0]
    out[first] *= -1
    out = np.cumsum(out)
    return out - np.repeat(np.append(0, out)[first], n[n > 0])


def path_counts(model: Model, context: np.ndarray, leaf: np.ndarray, weight: np.ndarray, reply: np.ndarray | None, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts along the paths of distinct rows, and where the path of each row begins: the rows' own, or those of the reply."""
    key, weight, which = distinct_rows(model, context, leaf, weight)
    if reply is None:
        context = key >> RANK
        new = np.append(True, context[1:] != context[:-1])[: len(key)]
        alone = new & np.append(new[1:], True)[: len(key)] & (weight < len(EVEN) // 64)  # one leaf is all that follows
        rest = np.flatnonzero(~alone)
        code, length, _ = turns(model, key[rest])
        begin = weight.astype(np.int64) * 64
        begin[rest] = np.cumsum(length + 1) - (length + 1) + len(EVEN)
        return np.append(EVEN, prefix_weights(np.arange(len(rest)), context[rest], code, length.astype(np.int16), weight[rest])), begin[which]
    order, _ = by_task(key, tasks)
    _, length, common = turns(model, key[order])
    begin, n = np.cumsum(length + 1) - (length + 1), length - common
    sums = np.empty(int((length + 1).sum()), np.float32)
    sums[np.arange(len(reply)) + np.repeat(begin + common + 1 - (np.cumsum(n) - n), n)] = counts_of(reply, n)
    where, common, size = begin, common, length
    for d in range(int(length.max(initial=-1)) + 1):
        new = common < d
        sums[where + d] = sums[where[new] + d][np.cumsum(new) - 1]
        live = size > d
        where, common, size = where[live], common[live], size[live]
    back = np.empty(len(order), np.int64)
    back[order] = begin
    return sums, back[which]


def lane_scores(model: Model, one: np.ndarray, two: np.ndarray, company: np.ndarray, leaf: np.ndarray, learns: np.ndarray, share: np.ndarray | None = None, replies: list[np.ndarray] | None = None, tasks: int = 1) -> np.ndarray:
    """log10 of the probability of each event's path, in the order of the events: counts of the corpus, mixed online.

    replies: the counts of the contexts that other lanes may hold as well; without them the events are the corpus.
    """
    size = model.length[leaf] + 1
    weight = learns.astype(np.float32)
    sums, offsets = [model.tree], [model.tree_at[leaf]]
    for k, (context, elsewhere) in enumerate(contexts(one, two, company, np.zeros(len(one), np.uint8) if share is None else share)):
        parts, offset, held = [], np.empty(len(leaf), np.int64), 0
        for rows, reply in ((elsewhere, replies[k]), (~elsewhere, None)) if replies is not None else ((np.ones(len(leaf), bool), None),):
            if rows.any():
                found, at = path_counts(model, context[rows], leaf[rows], weight[rows], reply, tasks)
                offset[rows] = at + held
                held += len(found)
                parts.append(found)
        sums.append(np.concatenate(parts) if parts else np.zeros(0, np.float32))
        offsets.append(offset)
    out = np.zeros(len(leaf))
    mixer = Mixer.new()

    slots = np.arange(int(size.max(initial=0)) * CHUNK)

    def score(rows: np.ndarray) -> None:
        """Nodes of the events' paths lie one after another; the last node of each, a leaf, is no choice."""
        n = size[rows]
        begin = np.cumsum(n) - n
        ends = begin + n - 1
        depth = slots[: int(n.sum())] - np.repeat(begin, n)
        less = weight[rows[0]]  # a batch is learnt from as a whole, or not at all
        x = np.empty((4, len(depth)), np.float32)
        for k, (c, offset) in enumerate(zip(sums, offsets, strict=True)):
            at = np.repeat(offset[rows], n)
            at += depth
            whole = c.take(at, mode="clip")
            if less:
                whole -= less
            taken = np.empty_like(whole)
            taken[:-1] = whole[1:]
            taken[ends] = whole[ends]
            if k == 0:
                p = np.maximum(taken, np.float32(0.25)) / np.maximum(whole, np.float32(0.5))
            else:
                back = np.float32(BACK[k - 1])
                p *= back
                p += taken
                p /= whole + back
            x[k] = odds(p)
            if k == 2:
                gates = ((whole > 0.5).view(np.uint8) + (whole > 3.5) + (whole > 31.5)) * np.uint8(32)
        gates += ((whole > 0.5).view(np.uint8) + (whole > 1.5) + (whole > 7.5)) * np.uint8(8)
        gates += ((taken > 0) & (taken < whole)).view(np.uint8) * np.uint8(4)
        gates += (depth > 0).view(np.uint8) + (depth > 3) + (depth > 8)
        logs = mixer.choices(x, gates.astype(np.int64), ends if less else None)
        logs[ends] = 0
        out[rows] = np.add.reduceat(logs, begin)

    taught, others = np.flatnonzero(learns), np.flatnonzero(~learns)
    waiting = np.searchsorted(taught, others)  # how many are learnt from before each of the others
    at = step = done = 0
    while done < len(others) or at < len(taught):
        step = min(2 * step or FIRST, LAST)
        end = len(others) if at + step >= len(taught) else int(np.searchsorted(waiting, at + step))
        for k in range(done, end, CHUNK):
            score(others[k : min(end, k + CHUNK)])
        for k in range(at, min(at + step, len(taught)), CHUNK):
            score(taught[k : min(at + step, k + CHUNK)])
        if at < len(taught):
            mixer.learn()
        at, done = at + step, end
    return out


READERS: dict[str, Reader] = {}
#: What is added up for each document, and what a lane sends of it: the mixed score alone, or all of it.
SUMS = {"rows": "i4", "tokens": "i8", "bytes": "i8", "known": "i8", "base": "f8", "mixed": "f4", "spelled": "f4"}
SENT = [["mixed"], list(SUMS)]


EVENT = ("u2", "u4", "u4", "u4", "u1", "u1", "u1", "u4")


def read_pieces(pieces: pa.Table, which: int, *kinds: str) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """The documents of the pieces of a kind, their arrays one after another, and their words."""
    columns = {k: pieces.column(k) for k in ("docs", "data", "words")}
    docs, data, names, before = [], [], [], 0
    for k in np.flatnonzero(np.asarray(pieces.column("kind")) == which).tolist():
        delta, digest, flags = unpacked(columns["docs"][k].as_py(), "i8", "u4", "u1")
        arrays = unpacked(columns["data"][k].as_py(), *kinds)
        if which < 2:
            arrays[0] = arrays[0].astype(np.int32) + np.int32(before)
        if which == 0:
            arrays[1] = np.cumsum(arrays[1], dtype=np.uint32)
        before += len(delta)
        docs.append((np.cumsum(delta), digest, flags))
        data.append(arrays)
        if which == 1:
            names += zstandard.decompress(columns["words"][k].as_py()).split(b" ")
    gather = lambda parts, kinds: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]
    return gather(docs, ("i8", "u4", "u1")), gather(data, kinds), names


def read_events(model: Model, pieces: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The documents and the arrays of the events, whose words before are 24 bits of hashes from here on."""
    docs, (row, one, two, *rest), _ = read_pieces(pieces, 0, *EVENT)
    edge, above = len(model.words), np.uint32(HASHED)
    first = model.hashes[np.minimum(one, edge)]
    both = mixed_hash(first + model.hashes[np.minimum(two, edge)] * ODD)
    one, two = (np.where(x < above, h >> np.uint64(40), x - above).astype(np.uint32) for x, h in ((one, first), (two, both)))
    return docs, [row, one, two, *rest]


def lane_requests(model: Model, tasks: int, lane: int, pieces: pa.Table) -> pa.Table:
    """(task, who, data): a lane's counts of the contexts that others may hold too, by kind, part and the task that adds them up."""
    docs, (row, one, two, leaf, company, _, share, _) = read_events(model, pieces)
    out: dict[str, list] = {"task": [], "who": [], "data": []}
    learns = (docs[2][row] & 1) == 0
    for part in range(PARTS):
        at = np.flatnonzero(one % PARTS == part)
        for k, (context, elsewhere) in enumerate(contexts(one[at], two[at], company[at], share[at])):
            rows = at[elsewhere]
            key, weight, _ = distinct_rows(model, context[elsewhere], leaf[rows], learns[rows])
            order, task = by_task(key, tasks)
            for some in np.split(order, np.flatnonzero(np.diff(task)) + 1) if len(order) else ():
                out["task"].append(k * tasks + int(by_task(key[some[:1]], tasks)[1][0]))
                out["who"].append(lane * PARTS + part)
                out["data"].append(packed(np.diff(key[some], prepend=np.uint64(0)), weight[some].astype(np.uint32)))
    return pa.table({"task": pa.array(out["task"], pa.int32()), "who": pa.array(out["who"], pa.int64()), "data": pa.array(out["data"], pa.binary())})


def lane_sums(model: Model, buckets: int, tasks: int, pieces: pa.Table, others: pa.Table) -> pa.Table:
    """(bucket, kind, data): what a lane adds to each document, packed by buckets of documents.

    others: counts of the lane's words outside the alphabet, and the replies to its requests.
    """
    answers: dict[tuple[int, int], list] = {}
    answered = others.filter(pc.is_valid(others.column("who")))
    for who, task, data in zip(*(answered.column(c).to_pylist() for c in ("who", "task", "data")), strict=True):
        answers.setdefault((who % PARTS, task // tasks), []).append((task, data))
    words = others.filter(pc.is_valid(others.column("word"))).select(["word", "seen"])
    read = lambda which, *kinds: read_pieces(pieces, which, *kinds)
    out: dict[str, list] = {"bucket": [], "kind": [], "data": []}

    def send(which: int, docs: list[np.ndarray], **sums: np.ndarray) -> None:
        ids, digest, flags = docs
        named = np.where(flags & 4, digest, 0).astype(np.uint32)  # the id alone tells the other documents apart
        bucket = (mixed_hash(ids.view(np.uint64) * ODD + EDGE) % np.uint64(buckets)).astype(np.int64)
        values = [np.asarray(sums.get(c, np.zeros(len(ids)))).astype("f4" if which == 0 else SUMS[c]) for c in SENT[which]]
        order = np.lexsort((ids, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            out["bucket"].append(int(bucket[part[0]]))
            out["kind"].append(which)
            out["data"].append(packed(np.diff(ids[part], prepend=0), named[part], flags[part] & 2, *(v[part] for v in values)))

    def send_rows(which: int, docs: list[np.ndarray], rows: np.ndarray, *values: np.ndarray) -> None:
        """Numbers for words of documents, rather than sums: the path of a repeated word (2) or its name (3)."""
        ids, digest, flags = (x[rows] for x in docs)
        named = np.where(flags & 4, digest, 0).astype(np.uint32)
        bucket = (mixed_hash(ids.view(np.uint64) * ODD + EDGE) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            out["bucket"].append(int(bucket[part[0]]))
            out["kind"].append(which)
            out["data"].append(packed(np.diff(ids[part], prepend=0), named[part], flags[part] & 2, *(v[part] for v in values)))

    docs, (base, known, tokens, size), _ = read(2, "f8", "i8", "i8", "i8")
    send(1, docs, rows=np.ones(len(base)), base=base, known=known, tokens=tokens, bytes=size)

    docs, (row, times), names = read(1, "u2", "u4")
    if names:
        coded = pa.array(names, pa.binary()).dictionary_encode()
        which, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=words.column("word").combine_chunks().cast(pa.binary())), -1)
        seen = np.append(np.asarray(words.column("seen")), 0)[np.asarray(at)][which]
        rest = np.maximum(seen - np.where((docs[2][row] & 1) == 0, times, 0), 0)
        shapes = shapes_of(distinct)[which]
        unseen = np.flatnonzero(rest == 0)
        spelled = np.zeros(len(names))
        spelled[unseen] = model.spelled([names[k] for k in unseen.tolist()])
        total = lambda values: np.bincount(row, values, len(docs[0]))
        named = model.named(shapes, rest)
        send(1, docs, known=total(times * (seen > 0)), base=total(times * model.base(seen)), mixed=total(named), spelled=total(spelled))
        again = np.flatnonzero(times > 1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(names[k], 42) for k in again.tolist()), np.uint64, len(again))
        send_rows(3, docs, row[again], labels(hashes), named[again].astype(np.float32))

    docs, (row, one, two, leaf, company, own, marked, label) = read_events(model, pieces)
    share = marked & np.uint8(SPLIT - 1)
    if len(row):
        total, ids = np.zeros(len(docs[0])), docs[0].view(np.uint64) + docs[1].astype(np.uint64) * ODD
        for part in range(PARTS):
            at = np.flatnonzero(one % PARTS == part)
            if not len(at):
                continue
            key = mixed_hash(ids[row[at]] * ODD2 + (one[at].astype(np.uint64) << np.uint64(24) | two[at])) + leaf[at].astype(np.uint64) * ODD
            key += (label[at].astype(np.uint64) << np.uint64(16) | share[at].astype(np.uint64) << np.uint64(8) | own[at]) * EDGE
            at = at[np.argsort(key)]  # events of one key are alike
            leaves = leaf[at].astype(np.int32)
            replies = [np.concatenate([np.zeros(0, np.uint32), *(unpacked(x, "u4")[0] for _, x in sorted(answers.get((part, k), ())))]) for k in range(3)]
            logs = lane_scores(model, one[at], two[at], company[at], leaves, (docs[2][row[at]] & 1) == 0, marked[at], replies, tasks)
            plain = label[at] == 0
            total += np.bincount(row[at][plain], believed(logs[plain], own[at][plain], share[at][plain]), len(total))
            again = at[~plain]
            send_rows(2, docs, row[again], label[again], logs[~plain].astype(np.float32), own[again], share[again])
        send(0, docs, mixed=total)
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.int8()), "data": pa.array(out["data"], pa.binary())})


def believed(logs: np.ndarray, own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of the probability of words, from that of the mixer and what the text's own words give."""
    given, share_of = fine(own.astype(float), share.astype(float))
    return np.log10(np.maximum((1 - share_of) * 10.0**logs + given, 1e-300))


def repeated_words(rows: dict[int, list[list[np.ndarray]]]) -> tuple[np.ndarray, ...]:
    """ids, digest, flags and log10 of the probability of each repeated word outside the alphabet: rows by kind 2 and 3."""
    (ids, digest, flags, label, path, own, share), named = ([np.concatenate(x) for x in zip(*rows[k], strict=True)] for k in (2, 3))
    key = lambda i, d, f, w: mixed_hash(mixed_hash(i.view(np.uint64) * ODD + d.astype(np.uint64) * ODD2 + f.astype(np.uint64)) + w.astype(np.uint64) * ODD)
    known = key(*named[:4])
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], key(ids, digest, flags, label))]
    return ids, digest, flags, believed(path.astype(float) + named[4][at], own, share)


def document_sums(pieces: pa.Table) -> pa.Table:
    """A row for each document of a bucket: doc_id, digest, null and the SUMS."""
    parts, rows = [], {2: [], 3: []}
    for which, data in zip(pieces.column("kind").to_pylist(), pieces.column("data"), strict=True):
        if which in rows:
            delta, *values = unpacked(data.as_py(), "i8", "u4", "u1", "u4", "f4", *(("u1", "u1") if which == 2 else ()))
            rows[which].append([np.cumsum(delta), *values])
            continue
        delta, digest, flags, *values = unpacked(data.as_py(), "i8", "u4", "u1", *("f4" if which == 0 else SUMS[c] for c in SENT[which]))
        found = dict(zip(SENT[which], values, strict=True))
        parts.append((np.cumsum(delta), digest, flags, *(found[c].astype(float) if c in found else np.zeros(len(delta)) for c in SUMS)))
    if rows[2]:
        *names, mixed = repeated_words(rows)
        parts.append((*names, *(mixed if c == "mixed" else np.zeros(len(mixed)) for c in SUMS)))
    ids, digest, flags, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((digest, ids, flags))
    ids, digest, flags = ids[order], digest[order], flags[order]
    starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (digest[1:] != digest[:-1]) | (flags[1:] != flags[:-1])))
    sums = {c: np.add.reduceat(v[order], starts) for c, v in zip(SUMS, values, strict=True)}
    return pa.table({"doc_id": ids[starts], "null": flags[starts] > 0} | sums)


def score_documents(docs: DataFrame, modulus: int = 7, alphabet: int = ALPHABET, lane: int = LANE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte for every row of docs.

    A null text is scored as an empty one: its only token is the end. A null doc_id counts as an empty text in the rule of
    the fold. Repeated rows are scored each and learnt from each. Without training documents the tree has classes alone,
    and the base is log10 of 1. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = stored(word_counts(docs, modulus))
    fitted = fit(words, alphabet, lane)
    names, seen, n, lanes = fitted.words, fitted.seen, fitted.tokens, fitted.lanes
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.pmod("doc_id", F.lit(REPEATED)).alias("i")).distinct().toArrow()
    fitted.repeated = np.zeros(REPEATED, bool)
    fitted.repeated[np.asarray(again.column(0)).astype(np.int64)] = True
    model, key = spark.sparkContext.broadcast(fitted.prepare()), uuid.uuid4().hex

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in READERS:
            READERS.clear()
            READERS[key] = Reader(model.value)
        kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
        for block in blocks(batches, BLOCK_BYTES, BLOCK_TEXTS):
            ids, digests, held, texts = (c.combine_chunks() for c in block.columns)
            pieces = list(zip(*READERS[key].block(ids.to_pylist(), np.asarray(digests), np.asarray(held.cast(pa.int8())) > 0, texts), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(pieces, kinds, strict=True)], names=["lane", "kind", "docs", "data", "words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), held_out("doc_id", modulus).alias("held"), "text")
    pieces = rows.mapInArrow(over, "lane int, kind byte, docs binary, data binary, words binary")
    # A lane is much work for few bytes: a fixed number of partitions keeps Spark from merging lanes by their size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lanes // 4)
    tasks = min(parts, TASKS)
    pieces = pieces.repartition(parts, "lane")
    asked = pieces.groupBy("lane").applyInArrow(lambda lane, some: lane_requests(model.value, tasks, lane[0].as_py(), some), "task int, who long, data binary")
    told = asked.repartition(parts, "task").groupBy("task").applyInArrow(lambda some: whole_counts(model.value, some), "lane int, who long, task int, data binary")
    others = outside(words, names, seen).where("seen > 0").select(F.pmod(F.xxhash64("word"), F.lit(lanes)).cast("int").alias("lane"), "word", "seen")
    others = others.unionByName(told, allowMissingColumns=True)
    sums = pieces.groupBy("lane").cogroup(others.repartition(parts, "lane").groupBy("lane"))
    sums = sums.applyInArrow(lambda left, right: lane_sums(model.value, parts, tasks, left, right), "bucket int, kind byte, data binary")
    total = sums.repartition(parts, "bucket").groupBy("bucket").applyInArrow(document_sums, "doc_id long, null boolean, " + ", ".join(f"{c} double" for c in SUMS))
    each = lambda c: F.col(c) / F.col("rows")
    total = total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn("doc_id", F.when(~F.col("null"), F.col("doc_id")))
    return total.select(
        "doc_id", held_out("doc_id", modulus).alias("held_out"), each("tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("mixed").alias("score"), each("bytes").cast("long").alias("n_bytes"),
        (-(F.col("mixed") + F.col("spelled")) * 3.321928094887362 / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def total_bits_per_byte(scored: DataFrame) -> DataFrame:
    """held_out, documents, bytes and bits_per_byte over all documents of a result of score_documents."""
    bits = F.sum(F.col("bits_per_byte") * F.greatest("n_bytes", F.lit(1)))
    return scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_bytes").alias("bytes"), (bits / F.sum(F.greatest("n_bytes", F.lit(1)))).alias("bits_per_byte"))
