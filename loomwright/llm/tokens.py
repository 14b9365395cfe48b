"""Token ids of a public word-level BPE, and files of independent zstandard frames that hold them.

File format (the public zstandard seekable format, ids as little-endian unsigned integers of `width` bytes):

    frame 0 .. frame n-2    FRAME ids each, the last one fewer; a document may cross frames
    frame n-1               index: doc_id int64 and number of ids int64 of each document, in file order
    seek table              skippable frame: compressed size, size and checksum (low half of XXH64) of each frame, footer

A reader takes the seek table and the index from the end, and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm.common import shared_folder, stored, words_of

END = 2
FRAME = 1 << 16
#: Magic numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)
#: ASCII and Latin-1 letters, in UTF-8, with or without punctuation after them.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
#: The byte-level alphabet: printable characters of Latin-1 stand for their bytes, the other bytes follow from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b for b in PLAIN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PLAIN)}


class WordCodec:
    """Encodes texts word by word, each distinct word once.

    The tokenizer drops white space and neither normalises nor merges across it, so the ids of a text are those of its
    words in order. Words of Latin letters, with punctuation or not, need only lower case and go to the BPE model
    directly. Of what is known, the words seen least are dropped when there are more than `most`.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.whole, self.most = Tokenizer.from_file(path), most
        self.model = self.whole.model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = Rows()
        self.starts, self.counts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.hits = np.zeros(1024, np.int64)
        self.known = self.used = 0

    def shrink(self) -> None:
        """Keeps the words seen most, at most half of the limit."""
        hits = self.hits[: self.known]
        least = 2
        while (hits >= least).sum() > self.most // 2:
            least *= 2
        kept = np.flatnonzero(hits >= least)
        words = list(self.rows)
        starts, counts = self.starts[kept], self.counts[kept]
        ids, hits = [self.ids[a : a + n] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)], hits[kept] // 2
        self.clear()
        self.rows.update(zip((words[k] for k in kept.tolist()), range(len(kept)), strict=True))
        self.store(counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32), hits)

    def store(self, counts: np.ndarray, new: np.ndarray, hits: np.ndarray) -> None:
        need, words = self.used + len(new), self.known + len(counts)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        if words > len(self.starts):
            for name in ("starts", "counts", "hits"):
                setattr(self, name, np.concatenate([getattr(self, name)[: self.known], np.zeros(2 * words - self.known, np.int64)]))
        self.ids[self.used : need] = new
        self.counts[self.known : words] = counts
        self.hits[self.known : words] = hits
        self.starts[self.known : words] = self.used + np.cumsum(counts) - counts
        self.known, self.used = words, need

    def learn(self) -> None:
        fresh, self.rows.fresh = self.rows.fresh, []
        found: list[list[int] | None] = []
        hard = []
        tokens = self.model.tokenize
        for word in fresh:
            if m := SIMPLE.fullmatch(word):
                letters, stops = m.groups()
                plain = letters.lower().decode()
                if not plain.isascii():
                    plain = plain.lower().encode().decode("latin-1").translate(ALPHABET)
                ids = [t.id for t in tokens(plain)]
                found.append(ids + [t.id for t in tokens(stops.decode())] if stops else ids)
            else:
                hard.append(word.decode())
                found.append(None)
        rest = iter(self.whole.encode_batch_fast(hard, add_special_tokens=False)) if hard else iter(())
        found = [next(rest).ids if x is None else x for x in found]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
        self.store(counts, new, np.zeros(len(counts), np.int64))

    def encode(self, texts: list[str | None], end: int | None = END) -> list[np.ndarray]:
        """The ids of each text, with `end` after them."""
        if len(self.rows) > self.most:
            self.shrink()
        get = self.rows.__getitem__
        rows = []
        for text in texts:
            words = words_of(text)
            rows.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.rows.fresh:
            self.learn()
        if rows:
            self.hits[: self.known] += np.bincount(np.concatenate(rows), minlength=self.known)
        out = []
        for row in rows:
            counts = self.counts[row]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(row) else 0
            ids = np.empty(total + (end is not None), np.uint32)
            ids[:total] = self.ids[np.repeat(self.starts[row] - (ends - counts), counts) + np.arange(total)]
            if end is not None:
                ids[total] = end
            out.append(ids)
        return out


class Rows(dict):
    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The worker's codec: what one task learnt serves the next."""
    if path not in CODECS:
        CODECS[path] = WordCodec(path)
    return CODECS[path]


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class FrameWriter:
    """Writes one file; finish() returns (documents, ids)."""

    def __init__(self, out, width: int, frame: int = FRAME):
        self.out, self.kind, self.frame = out, f"<u{width}", frame
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[tuple[int, int]] = []

    def put(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.frame:
            every = np.concatenate(self.held)
            end = len(every) - len(every) % self.frame
            for at in range(0, end, self.frame):
                self.put(every[at : at + self.frame].astype(self.kind).tobytes())
            self.held, self.waiting = [every[end:]], len(every) - end

    def finish(self) -> tuple[int, int]:
        if self.waiting:
            self.put(np.concatenate(self.held).astype(self.kind).tobytes())
        self.put(np.array(self.docs, "<i8").reshape(-1, 2).T.tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        return len(self.docs), self.total


class FrameReader:
    """Reads one file with random access. Raises ValueError where a frame does not match its checksum."""

    def __init__(self, source, width: int, frame: int = FRAME):
        self.source, self.width, self.frame = source, width, frame
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.table = np.frombuffer(self.at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.doc_ids, self.counts = np.frombuffer(self.load(count - 1), "<i8").reshape(2, -1)
        self.starts = np.cumsum(self.counts) - self.counts
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def load(self, number: int) -> bytes:
        packed, size, checksum = self.table[number]
        raw = zstandard.ZstdDecompressor().decompress(self.at(self.places[number], packed), max_output_size=int(size))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        return raw

    def document(self, number: int) -> np.ndarray:
        """The ids of the document at a place in the file; only its frames are decompressed."""
        start, stop = int(self.starts[number]), int(self.starts[number] + self.counts[number])
        parts = []
        for frame in range(start // self.frame, (max(stop, start + 1) - 1) // self.frame + 1) if stop > start else ():
            if self.last[0] != frame:
                self.last = (frame, np.frombuffer(self.load(frame), f"<u{self.width}"))
            parts.append(self.last[1][max(0, start - frame * self.frame) : stop - frame * self.frame])
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, width: int = 2, end: int = END) -> DataFrame:
    """Writes every document's ids to files in folder, in ascending doc_id order, and returns (part, file, docs, ids).

    Spark deals the texts by ranges of doc_id; a task encodes and writes its range as one file under a name of its own
    attempt. Only files that the returned table names belong to the result, so attempts that were lost or ran twice do
    no harm. folder is any address that pyarrow's file systems can write and all executors share.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, writer, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst", None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    writer = FrameWriter(out, width)
                for doc_id, ids in zip(part.column(0).to_pylist(), codec(tokenizer).encode(part.column(1).to_pylist(), end), strict=True):
                    writer.add(NULL_ID if doc_id is None else doc_id, ids)
        if writer is not None:
            n, total = writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "docs": [n], "ids": [total]})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(over, "part long, file string, docs long, ids long"))


def read_tokens(files: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that write_tokens returned.

    The list of files is as long as the writing stage had tasks; the documents before each file are summed on it.
    """
    rows, before = [], 0
    for r in files.orderBy("part").collect():
        rows.append((r["file"], before))
        before += r["ids"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    reader = FrameReader(source, width)
                    for at in range(0, len(reader.counts), 4096):
                        crcs = [crc_of(reader.document(k)) for k in range(at, min(at + 4096, len(reader.counts)))]
                        ids = reader.doc_ids[at : at + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=ids == NULL_ID), pa.array(start + reader.starts[at : at + 4096]), pa.array(reader.counts[at : at + 4096]), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spark = files.sparkSession
    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))
    return listed.mapInArrow(over, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, width: int = 2, end: int = END) -> DataFrame:
    """Writes the ids of docs and reads them back.

    One row per row of docs: doc_id, start, n_tokens, ids_crc32. A null or empty text has only the end id. Rows that
    share a doc_id are documents of their own, in the order of a hash of their texts; a null doc_id comes first. Other
    columns are not read. An empty table writes no file and gives an empty result.
    """
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer, width, end), folder, width)
