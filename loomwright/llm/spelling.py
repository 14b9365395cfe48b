"""Spelling variants by anagram hashing.

A word's anagram key is the sum of the fifth powers of its code points: words with the same letters share it, and adding,
removing or exchanging a letter adds, takes or exchanges that letter's value. Every word is listed under its own key and,
for each letter, under the key without that letter's value. Words that differ by one letter meet there: one lacks a letter
of the other, or both lack one. Of the words that meet, those whose letters stand in the same order are taken, by a hash of
what is left of the word, and compared letter by letter at the end.

A word is listed once more than it has letters, with numbers only. Rows of a key are sorted, not paired: pairs are those
that agree in what is left of them and in the place of the letter, of which there are at most as many as letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import by_key, kept_rows, stored, trimmed

LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters of a text that are taken at once, and of distinct words that a task counts before it passes them on.
SLICE, HELD = 1 << 20, 8 << 20
#: Hashes of what is left of a word: polynomials modulo a prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A8C6E


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about `size` characters, cut where no letter stands."""
    cut, at = re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        found = cut.search(text, at + size)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, least: int, modulus: int) -> DataFrame:
    """word, n: how often each word of `least` letters or more stands in the texts; see spelling_variants for the misspelt."""
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in slices(text or ""):
                    for word, n in Counter(run.findall(part)).items():
                        word = word if word.islower() else word.translate(LOWER)
                        h = zlib.crc32(word.encode(), start) if modulus else 1
                        if modulus and h % modulus == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1 :]
                        if len(word) >= least:
                            if word not in counts:
                                held += len(word) + 8
                            counts[word] += n
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                        counts, held = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        del counts
        trimmed()

    return docs.select("doc_id", "text").mapInArrow(over, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def anagram_key(word: str) -> int:
    """The sum of the fifth powers of the code points, in 64 bits."""
    return (sum(ord(c) ** 5 for c in word) + (1 << 63)) % (1 << 64) - (1 << 63)


def listed(word: str) -> list[tuple[int, int, int, bool]]:
    """(key, rest, place, first) of a word: itself at place -1, then without each letter; first: of a run of equal letters.

    rest is a hash of the letters left, in their order.
    """
    codes, head = list(map(ord, word)), [0]
    for c in codes:
        head.append((head[-1] * BASE + c) % PRIME)
    key, power = anagram_key(word), 1
    found = [(key, head[-1], -1, True)]
    for at in range(len(codes) - 1, -1, -1):
        rest = ((head[at] - head[at + 1]) * power + head[-1]) % PRIME
        less = (key - codes[at] ** 5 + (1 << 63)) % (1 << 64) - (1 << 63)
        found.append((less, rest, at, at == 0 or codes[at - 1] != codes[at]))
        power = power * BASE % PRIME
    return found


def meetings(key: np.ndarray, rest: np.ndarray, word: np.ndarray, place: np.ndarray, first: np.ndarray) -> Iterator[dict]:
    """Pairs (a, b, place, shorter): b is a with another letter at the place, or, if shorter, without it."""
    order = np.lexsort((place, rest, key))
    key, rest, word, place, first = (x[order] for x in (key, rest, word, place, first))
    new = np.append(True, (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    whole = np.flatnonzero((place[start] == -1) & (place >= 0) & first)
    yield {"a": word[whole], "b": word[start[whole]], "place": place[whole], "shorter": np.ones(len(whole), bool)}
    step, live = 1, np.flatnonzero(place >= 0)
    while len(live := live[live + step < len(key)]):
        live = live[(start[live] == start[live + step]) & (place[live] == place[live + step])]
        yield {"a": word[live], "b": word[live + step], "place": place[live], "shorter": np.zeros(len(live), bool)}
        step += 1


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: the pairs of `words` (id, word, n) that differ by one letter, in both directions."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(number, *found) for found in listed(word)]
                if len(rows) > 1 << 16:
                    yield columns(rows)
                    rows = []
            if rows:
                yield columns(rows)

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        arrays = [pa.array(values, t) for values, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "key", "rest", "place", "first"])

    places = words.select("id", "word").mapInArrow(spread, "id long, key long, rest long, place int, first boolean")
    met = by_key(places, "key", ["key", "rest", "id", "place", "first"], meetings, "a long, b long, place int, shorter boolean")
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    after = F.col("place") + F.when(F.col("shorter"), 1).otherwise(2)
    end = lambda column, start: F.substr(F.col(column), start, F.length(column) + 1)
    same = F.substr(F.col("word_a"), F.lit(1), F.col("place")) == F.substr(F.col("word_b"), F.lit(1), F.col("place"))
    same &= end("word_a", F.col("place") + 2) == end("word_b", after)
    length = F.length("word_b") == F.length("word_a") - F.col("shorter").cast("int")
    found = met.join(side("a"), "a").join(side("b"), "b").where(same & length)
    both = [F.struct(*(F.col(f"{c}_{x}").alias(n) for c, x, n in (("word", p, "word"), ("n", p, "n"), ("word", q, "near"), ("n", q, "near_n")))) for p, q in ("ab", "ba")]
    return found.select(F.explode(F.array(*both)).alias("s")).select("s.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows of forms (word, form): where following forms ends. Steps double in every round."""
    now = kept_rows(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = kept_rows(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5, modulus: int = 199) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs (doc_id, text).

    Words are maximal runs of letters (ASCII and U+00C0 to U+00FF) of at least `least` code points that occur `often`
    times or more; A-Z alone are lower-cased. With a modulus, runs whose crc32 with their document's id is divisible by it
    lose a letter first, as if misspelt; without (0), words are counted as they stand. Words are near that differ by one
    inserted, deleted or replaced code point. A word's form is its near word of largest n, ties to the smallest in
    code-point order, if that is at least `times` its own n, else null; root is where following forms ends.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each. Words of any
    length are compared whole. No words give an empty result. Other columns are not read.
    """
    counts = word_counts(docs, least, modulus).where(F.col("n") >= often)
    words = stored(counts.withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = stored(near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    found = words.join(near, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    known = stored(found.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
