"""Three chunkers for texts in Arrow batches: windows of characters, sentences and paragraphs, chosen row by row.

Sizes are in estimated tokens: the larger of a quarter of the characters and the number of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where sentences and paragraphs end, how much deeper an indented line starts a paragraph, short paragraphs.
SENTENCE_END = re.compile(r"(?<!\b[A-Z])[.!?。۔؟]+(?=\s+[A-Z0-9\"'])")
PARAGRAPH_END = re.compile(r"\n\s*\n+")
INDENT, SHORT = 2, 50


def tokens(text: str) -> int:
    return max(len(text) // 4, len(text.split()))


def filled(pieces: list[str]) -> list[str]:
    return [p for p in map(str.strip, pieces) if p]


def by_characters(text: str, room: int, overlap: int) -> list[str]:
    """Windows of 4 characters a token; each begins `overlap` characters before the end of the last, and moves on by one at least."""
    starts, at = [], 0
    while at < len(text):
        starts.append(at)
        at = len(text) if at + 4 * room >= len(text) else max(at + 4 * room - overlap, at + 1)
    return filled([text[s : s + 4 * room] for s in starts])


def by_words(text: str, room: int, overlap: int) -> list[str]:
    """As many words as fit; the last ones within `overlap` characters begin the next chunk. A word that is too long stands whole."""
    words = text.split()
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    out, first = [], 0
    for at in range(len(words)):
        if at > first and ends[at + 1] - ends[first] > 4 * room:
            out.append(" ".join(words[first:at]))
            first = bisect_left(ends, ends[at] - max(overlap, 0), first, at)
    return [*out, " ".join(words[first:])] if words else [text]


def within(chunks: list[str], room: int, cut) -> list[str]:
    return [piece for chunk in chunks for piece in (cut(chunk) if tokens(chunk) > room else [chunk])]


def by_sentences(text: str, room: int, keep: int, overlap: int) -> list[str]:
    """Sentences as many as fit; the last `keep` begin the next chunk. A sentence that is too long is cut between words."""
    sentences = filled(SENTENCE_END.split(text))
    if not sentences:
        return by_characters(text, room, overlap)
    out, held = [], []
    for sentence in sentences:
        long = tokens(sentence) > room
        if not long and tokens(" ".join([*held, sentence])) <= room:
            held.append(sentence)
            continue
        if held:
            out.append(" ".join(held))
        if long:
            out += by_words(sentence, room, overlap)
            held = out[-1:] if keep > 0 else []
        else:
            held = [*(held[-keep:] if keep > 0 else []), sentence]
    if held:
        out.append(" ".join(held))
    return within(out, room, lambda chunk: by_words(chunk, room, overlap))


def indented(text: str) -> list[str]:
    """Paragraphs by blank lines and by lines that begin deeper or less deep than the one before."""
    groups: list[list[str]] = [[]]
    last = None
    for line in text.split("\n"):
        plain = line.strip()
        if not plain:
            groups.append([])
            continue
        depth = len(line) - len(line.lstrip())
        if last is not None and abs(depth - last) > INDENT:
            groups.append([])
        groups[-1].append(plain)
        last = depth
    return ["\n".join(g) for g in groups if g]


def by_paragraphs(text: str, room: int, keep: int, overlap: int) -> list[str]:
    """Paragraphs as many as fit; the last `keep` begin the next chunk. What is too long, or has none, is cut by sentences."""
    if not text.strip():
        return []
    finer = lambda part: by_sentences(part, room, max(1, 2 * keep), overlap)
    paragraphs = filled(PARAGRAPH_END.split(text))
    if len(paragraphs) < 2 or all(len(p) < SHORT for p in paragraphs):
        other = indented(text)
        paragraphs = other if len(other) > len(paragraphs) else paragraphs
    if len(paragraphs) == 1 and tokens(paragraphs[0]) > 2 * room:
        return finer(text)
    out, held = [], []
    for paragraph in paragraphs:
        long = tokens(paragraph) > room
        if not long and tokens("\n\n".join([*held, paragraph])) <= room:
            held.append(paragraph)
            continue
        if held:
            out.append("\n\n".join(held))
        if long:
            out += finer(paragraph)
            held = []
        else:
            held = [*(held[-keep:] if keep > 0 else []), paragraph]
    if held:
        out.append("\n\n".join(held))
    return within(out, room, finer)


def chunk(text: str, strategy: str, room: int, keep: int, overlap: int) -> list[str]:
    """The chunks of a text; the whole text where a strategy finds none."""
    if strategy == "char":
        found = by_characters(text, room, overlap)
    elif strategy == "paragraph":
        found = by_paragraphs(text, room, max(1, keep // 2), overlap)
    else:
        found = by_sentences(text, room, keep, overlap)
    return found or [text]


def chunks(text: Column, strategy: Column, room: Column, keep: Column, overlap: Column) -> Column:
    """array<string>: the chunks of each text by its own row's strategy and sizes."""

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([chunk(*row) for row in zip(*columns, strict=True)], dtype=object)

    return cut(text, strategy, room, keep, overlap)
