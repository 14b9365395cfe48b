"""Chunking and routing of documents."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as tx

ENDS = re.compile(r"(?<=[.!?])\s+")


def packed_sentences(text: str, max_tokens: int, overlap: int) -> list[str]:
    """Sentences in order, as many as fit in 4 characters a token; the last `overlap` ones begin the next chunk."""
    room, out, held = 4 * max_tokens, [], []
    for sentence in (s for s in ENDS.split(text.strip()) if s):
        pieces = [sentence]
        if len(sentence) > room:
            pieces, line = [], ""
            for word in sentence.split():
                if line and len(line) + 1 + len(word) > room:
                    pieces.append(line)
                    line = ""
                line = f"{line} {word}" if line else word
            pieces.append(line)
        for piece in pieces:
            if held and sum(map(len, held)) + len(held) + len(piece) > room:
                out.append(" ".join(held))
                held = held[-overlap:] if overlap else []
                if sum(map(len, held)) + len(held) + len(piece) > room:
                    held = []
            held.append(piece)
    return [*out, " ".join(held)] if held else out


def sentence_chunks(docs: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """(doc_id, position, chunk): a fold over the sentences of each text, in Arrow batches; no shuffle."""

    def over(batches):
        for batch in batches:
            chunks = [packed_sentences(t or "", max_tokens, overlap) for t in batch["text"]]
            frame = pd.DataFrame({"doc_id": batch["doc_id"], "chunk": chunks}).explode("chunk").dropna(subset=["chunk"])
            frame["position"] = frame.groupby(level=0).cumcount().astype("int32")
            yield frame[["doc_id", "position", "chunk"]]

    return docs.select("doc_id", "text").mapInPandas(over, "doc_id long, position int, chunk string")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, position, chunk): the text between blank lines."""
    parts = F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return docs.select("doc_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("position", "chunk"))


def routed(text: Column, routes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first route with one of its keywords in the text."""
    low = F.lower(text)
    tests = [(name, reduce(lambda a, b: a | b, [low.contains(w) for w in words])) for name, words in routes]
    return reduce(lambda e, t: e.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0])).otherwise(default)


def audience(text: Column, patterns: list[tuple[str, str]], default: str = "general") -> Column:
    """The audience whose pattern matches most; the first of equals, the default without a match."""
    counts = lambda low: F.array(*[F.struct(F.regexp_count(low, F.lit(p)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(patterns)])
    best = tx.bound(F.lower(text), lambda low: F.array_max(counts(low)))
    return tx.bound(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise(default))
