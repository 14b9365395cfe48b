"""Personal data in texts, and terms that give it away.

Patterns find e-mail addresses, network addresses, card and phone numbers. The corpus then tells which terms reveal one of
the values found, an entity. With documents as the unit, IC(e) = log2(N / n(e)) is the information in entity e, and
PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) what a term that stands within a few words of it discloses. What they leave,
IC - PMI = -log2 P(e | t), is how many bits a reader of the term still lacks; as a difference, it doesn't move with the size
of the corpus. A term that leaves at most `removed` bits of some entity goes, one that leaves at most `generalised` bits
is replaced by its kind; wherever it stands, also where the entity does not.

A pair counts as evidence only with `support` independent witnesses: documents that differ in the words around the entity
and in each of four minima of hashes of their shingles, so that copies, near copies and shared passages are one witness.

Texts are read in place. What is shuffled are words beside entities and words that pass a bitmap of fixed size.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import stored, trimmed

KINDS = ["email", "ip", "card", "phone"]
#: The patterns of the kinds. Those of e-mail addresses start at their @, cards have 16 digits at least.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Bits of the bitmaps that tasks test words against.
BITS = 1 << 22
#: Odd factors: the least product of a document's shingle hashes with each is one signature of it.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(map(int, reversed(digits))):
        total += d if at % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = HOST.match(text, at + 1) if start < at else None
        end = found.end() if found else at + 1
        if found:
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, in code points, by kind, then start; linear in its length."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spaces for the spans: places stay."""
    parts, at = [], 0
    for start, end in sorted(s[1:] for s in spans):
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def term_of(word: str) -> tuple[str, int, int] | None:
    """The term in a word between spaces: lower-cased, without marks around it, 3 code points at least; and its place."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return (word[start:end].lower(), start, end) if end - start > 2 else None


def terms_in(text: str) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of a text, in order."""
    for m in WORD.finditer(text):
        if found := term_of(m[0]):
            yield found[0], m.start() + found[1], m.start() + found[2]


def entity(kind: str, value: str) -> int:
    """A hash of what a value is, however it is written: case of addresses, spacing of numbers."""
    plain = value.lower() if kind in ("email", "ip") else NOT_DIGITS.sub("", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - (1 << 63)


def signatures(words: list[str]) -> list[int]:
    """Four minima of the hashes of three-word shingles (of what there is, if fewer)."""
    shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
    return [int(v) - (1 << 63) for v in (hashes[:, None] * FACTORS).min(0)]


PAIRS = "entity long, term string, near long, s0 long, s1 long, s2 long, s3 long"


def beside_entities(docs: DataFrame, reach: int) -> DataFrame:
    """A row for each term within `reach` terms of an entity of a document, and one without a term for each entity of it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text or not (spans := base_spans(text)):
                    continue
                terms = list(terms_in(blanked(text, spans)))
                starts, words = [t[1] for t in terms], [t[0] for t in terms]
                signs, seen = signatures(words), set()
                for kind, start, end in spans:
                    who, at = entity(kind, text[start:end]), bisect_left(starts, start)
                    window = words[max(0, at - reach) : at + reach]
                    around = xxhash.xxh64_intdigest(" ".join(window)) - (1 << 63)
                    for term in [None, *window]:
                        if (who, term) not in seen:
                            seen.add((who, term))
                            rows.append((who, term, around, *signs))
            if rows:
                types = [pa.int64(), pa.string()] + [pa.int64()] * 5
                columns = [pa.array(values, t) for values, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["entity", "term", "near", "s0", "s1", "s2", "s3"])
        trimmed()

    return docs.select("text").mapInArrow(over, PAIRS)


def bitmap(terms: DataFrame) -> np.ndarray:
    """Bits at the hashes of the terms: BITS of them, whatever the number of terms."""
    places = terms.select((F.crc32(F.col("term").cast("binary")) % BITS).cast("int").alias("p")).distinct().toArrow()
    found = np.zeros(BITS, bool)
    found[np.asarray(places.column("p"))] = True
    return np.packbits(found)


class Passing:
    """The term of a word, if it passes a bitmap; remembers the last words."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.known = bits.tobytes(), {}

    def __call__(self, word: str) -> str | None:
        if (found := self.known.get(word, 0)) == 0:
            found = (term_of(word) or (None,))[0]
            if found is not None:
                at = zlib.crc32(found.encode()) % BITS
                found = found if self.bits[at >> 3] & 128 >> (at & 7) else None
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def terms(self, text: str) -> set[str]:
        """The terms of a text that pass, outside its personal data."""
        spans = base_spans(text)
        return {term for w in set((blanked(text, spans) if spans else text).split()) if (term := self(w))}


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: the number of documents in which each of `terms` stands outside personal data."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, counts = Passing(bits.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(passing.terms(text))
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
        trimmed()

    found = docs.select("text").mapInArrow(over, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return found.join(terms.select("term").distinct(), "term", "left_semi")


def revealing_terms(docs: DataFrame, removed: float = 0.25, generalised: float = 1.0, support: int = 3, reach: int = 8) -> DataFrame:
    """term, entity (a hash), together, information, disclosed, bits_left and action of terms that reveal an entity.

    Of several entities that a term reveals, the one of which it leaves the fewest bits is told. information is IC, disclosed
    PMI in bits. Counts are of documents, copies included; witnesses are independent ones, see above.
    """
    beside = stored(beside_entities(docs, reach))
    pairs = beside.where("term is not null")
    often = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= support)
    seen = pairs.join(often.select("entity", "term"), ["entity", "term"], "left_semi").groupBy("entity", "term")
    signs = ["near", "s0", "s1", "s2", "s3"]
    witnesses = F.least(*(F.col(f"d_{s}") for s in signs))
    backed = seen.agg(F.count(F.lit(1)).alias("together"), *(F.count_distinct(s).alias(f"d_{s}") for s in signs)).where(witnesses >= support)
    backed = stored(backed.select("entity", "term", "together"))
    total = docs.count()
    held = beside.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    counts = documents_with(docs, backed.select("term"))
    known = backed.join(counts, "term").join(held, "entity").select(
        "term", "entity", "together", F.log2(F.lit(float(total)) / F.col("n_entity")).alias("information"),
        F.log2(F.lit(float(total)) * F.col("together") / (F.col("n") * F.col("n_entity"))).alias("disclosed"), (-F.log2(F.col("together") / F.col("n"))).alias("bits_left"))
    least = known.where(F.col("bits_left") <= generalised).groupBy("term").agg(F.min(F.struct("bits_left", "entity", "together", "information", "disclosed")).alias("s"))
    action = F.when(F.col("bits_left") <= removed, "removed").otherwise("generalised")
    return stored(least.select("term", "s.*").withColumn("action", action))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,put:string>>"


def private_spans(docs: DataFrame, removed: float = 0.25, generalised: float = 1.0, support: int = 3, reach: int = 8) -> DataFrame:
    """doc_id, text and spans for every row of docs (doc_id, text).

    spans holds (kind, start, end, put) of personal data, by kind as in KINDS, then start, and after them of kind `term`
    those of revealing_terms; places are code points, end exclusive, put is what sanitised() writes instead. Terms that
    overlap personal data are part of it and no spans. Those of equal texts are found once and joined by a hash of the text. A null text is an empty one and has none; repeated rows and
    null ids are rows like others, and an empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = revealing_terms(docs, removed, generalised, support, reach)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word of a text that passes the bitmap, under the text's hash."""
        passing = Passing(bits.value)
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if some := passing.terms(text):
                    own = xxhash.xxh128_digest(text)
                    rows += [(own, t, a, b, text[a].isupper()) for t, a, b in terms_in(blanked(text, base_spans(text))) if t in some]
            if rows:
                types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["hash", "term", "start", "end", "upper"])
        trimmed()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("put", pa.string())])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b, "put": f"[{k.upper()}]"} for k, a, b in base_spans(text)] for text in texts]
            names = pa.array(map(xxhash.xxh128_digest, texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(kind)), names], names=["doc_id", "text", "spans", "hash"])
        trimmed()

    put = F.when(F.col("action") == "removed", "").when(F.col("term").rlike("^[0-9]+$"), "[NUMBER]").when(F.col("upper"), "[NAME]").otherwise("[WORD]")
    shape = F.struct(F.lit("term").alias("kind"), "start", "end", put.alias("put"))
    words = docs.select("text").mapInArrow(offered, "hash binary, term string, start long, `end` long, upper boolean").distinct()
    more = words.join(terms.select("term", "action"), "term").groupBy("hash").agg(F.sort_array(F.collect_list(shape)).alias("more"))
    base = docs.mapInArrow(judged, f"doc_id long, text string, spans {SPANS}, hash binary")
    spans = F.concat("spans", F.coalesce("more", F.array().cast(SPANS))).alias("spans")
    return base.join(more, "hash", "left").select("doc_id", "text", spans)


def sanitised(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by what it puts; where spans overlap, by the first's."""
    order = F.array_sort(spans, lambda a, b: F.when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(b.end - a.end)).cast("int"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(held: Column, s: Column) -> Column:
        kept = F.substr(F.col(text), (held.at + 1).cast("int"), (s.start - held.at).cast("int"))
        nothing = F.struct(held.done.alias("done"), F.greatest(held.at, s.end).alias("at"))
        return F.when(s.start < held.at, nothing).otherwise(F.struct(F.concat(held.done, kept, s.put).alias("done"), s.end.alias("at")))

    end = lambda held: F.concat(held.done, F.substr(F.col(text), (held.at + 1).cast("int"), F.length(text)))
    return F.aggregate(order, start, step, end)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of personal data of each kind, base_sha256 and spans, of what private_spans returned."""
    joined = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(lambda s: s.kind != "term").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(number, KINDS), base, joined(lambda s: F.lit(True)).alias("spans"))
