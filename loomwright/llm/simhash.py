"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding holds the number of set bits of each. Flipping a
bit changes one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of their
fingerprints. Fingerprints within 3 bits therefore differ by at most 1 in the embedding of one of their halves (16
segments each). That is a range join on a grid with a cell for each vector of half an embedding: a fingerprint enters
its own cell in each half, and the cells one step up from it; any two within range meet in a cell. What meets is
verified on the fingerprints themselves.

Three bits of 64 find nearly equal texts only: of pairs with a Jaccard similarity of 0.8 to 0.85 on five-word shingles
they hold one in a hundred, and no bound on 64 bits is implied by a similarity of sets, since a fingerprint counts repeats.
similar_groups() therefore takes what meets in the grid within 3 bits first and verifies it by whole shingle sets. What the
verified links leave apart goes through a filter by prefixes, an exact way for the rest: under one order of all shingles, two
sets of similarity t share one of the first n - ceil(t n) + 1 of n shingles of each. What shares one, and may reach t by its
sizes and the place of the shingle, is compared by whole shingle sets. Shingles that a sample shows in many texts come last in
the order, so that lines that many texts carry bring few texts together; the order decides the work only, never the result.

A cell passes on a spanning forest of its links, not all of them: that keeps
every component and grows with the rows of the cell, however many copies meet there. A cell or a shingle with more rows
than TILE is cut into tiles, and each pair of tiles is compared, and passes on its forest, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import SHORT, by_key, connected_components, join_trees, joined_groups, kept_rows, mapped, stored, tiled, words_of

SEED = 42
RADIUS = 3
#: Bits up to which the forest of a large group takes the nearest pairs first.
WIDE = 20
#: One document of SAMPLED is looked at for shingles that COMMON sampled documents share; MOST of them at most are put last.
SAMPLED, COMMON, MOST = 16, 4, 100_000
#: A group of candidates with more rows than this is compared along a forest of its nearest pairs first.
CROWD = 32
#: A cell with more rows than this is split by 16-bit bands before its links are sought.
LARGE = 1024


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.zeros(0, np.uint64)
    raw = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) of every row, whole texts: one pass, no shuffle."""

    def over(batch: pa.RecordBatch):
        fps = np.array([fingerprint(shingle_hashes(x, size)) for x in batch.column(1).to_pylist()], np.uint64)
        yield {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), over, "doc_id long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Set bits of the 32 two-bit segments: n x 32."""
    pairs = (fps[:, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]) & np.uint64(3)
    return np.array([0, 1, 1, 2], np.int64)[pairs.astype(np.int64)]


def grid_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, cell and whether it is the row's own cell, for every cell that a fingerprint enters."""
    counts = popcounts(fps)
    powers = 3 ** np.arange(16, dtype=np.int64)
    rows, cells, own = [], [], []
    for half in range(2):
        part = counts[:, 16 * half : 16 * half + 16]
        base = (part @ powers) * 2 + half
        rows.append(np.arange(len(fps)))
        cells.append(base)
        own.append(np.ones(len(fps), bool))
        row, segment = np.nonzero(part < 2)
        rows.append(row)
        cells.append(base[row] + 2 * powers[segment])
        own.append(np.zeros(len(row), bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)


def links_within(fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of one cell, in blocks of rows."""
    labels, groups = np.arange(len(fps)), [np.arange(len(fps))]
    if len(fps) > LARGE and radius < 4:  # within 3 bits, one of four 16-bit bands is equal
        groups = []
        for band in range(4):
            key = (fps >> np.uint64(16 * band)) & np.uint64(0xFFFF)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            groups += [g for g in np.split(order, cuts) if len(g) > 1]
    for group in groups:
        for at in range(0, len(group), 256):
            i, j = np.nonzero(np.bitwise_count(fps[group[at : at + 256], None] ^ fps[None, group[at:]]) <= radius)
            new = j > i
            i, j = group[at + i[new]], group[at + j[new]]
            chosen = join_trees(labels, i, j)
            if len(chosen):
                yield np.stack([fps[i[chosen]], fps[j[chosen]]], 1)


def cell_links(cells: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints that share a cell; at least one of the two is in its own cell. Cells are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    small = np.repeat(sizes <= 32, sizes)
    c, f, o = cells[small], fps[small], own[small]
    for gap in range(1, int(sizes[sizes <= 32].max(initial=1))):
        same = c[gap:] == c[:-gap]
        if not same.any():
            break
        near = same & (o[gap:] | o[:-gap]) & (np.bitwise_count(f[gap:] ^ f[:-gap]) <= radius)
        if near.any():
            yield f[gap:][near], f[:-gap][near]
    for k in np.flatnonzero(sizes > 32):
        group = np.unique(fps[starts[k] : starts[k] + sizes[k]])
        for found in links_within(group, radius):
            yield found[:, 0], found[:, 1]


def grid_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the column fp of distinct: enough for the components of all pairs within radius bits."""
    if radius > 3:
        raise ValueError("the grid's halves guarantee 3 bits")

    def spread(batch: pa.RecordBatch):
        fps = np.asarray(batch.column(0)).view(np.uint64)
        rows, cells, own = grid_rows(fps)
        yield {"cell": np.where(own, cells, ~cells), "fp": fps[rows].view(np.int64)}

    def meet(places: np.ndarray, marked: np.ndarray, fps: np.ndarray) -> Iterator[dict]:
        for a, b in cell_links(places, fps.view(np.uint64), marked >= 0, radius):
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    # A cell is dealt by its number; ~cell marks a neighbour's entry and sorts with the cell.
    entries = mapped(distinct.select("fp"), spread, "cell long, fp long", 4096)
    place = F.when(F.col("cell") < 0, F.bitwise_not("cell")).otherwise(F.col("cell"))
    dealt = tiled(entries.withColumn("own_cell", place), "own_cell", "fp")
    return by_key(dealt, "place", ["place", "cell", "fp"], meet, "a long, b long").distinct()


def simhash_components(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs; other columns are not read.

    Equal fingerprints are one node, named by its smallest doc_id, so copies cost nothing in the join. A null or empty
    text has the fingerprint zero and links like any other. Rows that repeat get equal results. A null doc_id gets the
    component of its fingerprint; it names none unless no other row has one. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, size))
    nodes = kept_rows(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = connected_components(grid_links(nodes, radius))
    smallest = nodes.join(member, nodes.fp == member.node, "left").withColumn("component", F.coalesce("component", "fp"))
    named = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = smallest.join(named, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of documents share, sorted, and in how many: an order of work, not of results."""

    def over(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"shingle": np.concatenate([np.unique(shingle_hashes(x, size)) for x in batch.column(0).to_pylist()]).view(np.int64)}

    sample = mapped(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text"), over, "shingle long")
    counts = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    most = counts.orderBy(F.desc("n"), "shingle").limit(MOST).collect()
    found = np.array([r.shingle for r in most], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in most], np.int64)[order]


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, of which a set at least that similar has one among its own first."""
    n = len(shingles)
    length = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if n and len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.argsort(np.where(common[at] == shingles, counts[at], 0), kind="stable")]
    return shingles[:length]


def may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """False where sets of n and m shingles, whose first common one is at place `at` and `to`, are less similar."""
    return np.minimum(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - 1e-6


def close_pairs(keys: np.ndarray, nodes: np.ndarray, component: np.ndarray, fps: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with one key that may link and are apart: all of a small group; of a large one a forest, nearest pairs first."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= CROWD, sizes)
    k, v, g, c, p = keys[small], nodes[small], component[small], n[small], at[small]
    for gap in range(1, int(sizes[sizes <= CROWD].max(initial=1))):
        near = (k[gap:] == k[:-gap]) & (g[gap:] != g[:-gap]) & may_link(c[gap:], p[gap:], c[:-gap], p[:-gap], similarity)
        if near.any():
            yield v[gap:][near], v[:-gap][near]
    for s in np.flatnonzero(sizes > CROWD):
        group = slice(starts[s], starts[s] + sizes[s])
        v, f, c, p = nodes[group], fps[group], n[group], at[group]
        first, of = np.unique(component[group], return_index=True, return_inverse=True)[1:]
        labels = first[of]
        for radius in (*range(4, WIDE + 1, 4), 64):
            for x in range(0, len(v), 256):
                y = slice(x, x + 256)
                near = labels[y, None] != labels[None, x:]
                if near.any():
                    near &= np.bitwise_count(f[y, None] ^ f[None, x:]) <= radius
                    near &= may_link(c[y, None], p[y, None], c[None, x:], p[None, x:], similarity)
                i, j = np.nonzero(near)
                chosen = join_trees(labels, i + x, j + x)
                if len(chosen):
                    yield v[x + i[chosen]], v[x + j[chosen]]


def parity(shingles: np.ndarray) -> bytes:
    """1024 bits, each the parity of the shingles that fall on it: two sets differ in as many shingles as bits, at least."""
    return np.packbits(np.bincount((shingles & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).tobytes()


def cross_pairs(keys: np.ndarray, nodes: np.ndarray, component: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of nodes with one key that may link and are not in one component."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for s, e in zip(starts, np.append(starts[1:], len(keys)), strict=True):
        v, g, c, p, w = nodes[s:e], component[s:e], n[s:e], at[s:e], bits[s:e]
        for x in range(0, len(v), 256):
            y = slice(x, x + 256)
            apart = g[y, None] != g[None, x:]
            if not apart.any():
                continue
            i, j = np.nonzero(apart & may_link(c[y, None], p[y, None], c[None, x:], p[None, x:], similarity))
            i, j = i[j > i] + x, j[j > i] + x
            for z in range(0, len(i), 65536):
                a, b = i[z : z + 65536], j[z : z + 65536]
                apart_by = np.bitwise_count(w[a] ^ w[b]).sum(1, dtype=np.int64)
                near = apart_by <= (1 - similarity) / (1 + similarity) * (c[a] + c[b]) + 1e-6
                if near.any():
                    yield v[a[near]], v[b[near]]


def joined_by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined on doc_id; the ids are broadcast only where they are few."""
    few = ids.limit(SHORT + 1).count() <= SHORT
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints are equal or meet in the grid within RADIUS bits.

    A fingerprint stands for its smallest node: the others pair with that one, so that pairs grow with the nodes.
    """
    prints = kept_rows(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes")))
    equal = joined_groups(nodes.select("node", "fp"), prints.where("nodes > 1"), "fp", "nodes").select(F.col("least").alias("x"), F.col("node").alias("y"))
    left, right = (prints.select(F.col("fp").alias(c), F.col("least").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    near = grid_links(prints).join(left, "a").join(right, "b").select("x", "y")
    return equal.union(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that have others as similar: component_id is the smallest doc_id linked.

    Two documents link if their sets of shingles have a Jaccard similarity of at least `similarity`, computed exactly on
    pairs that meet in the grid of fingerprints, and then on those that are still apart and share a shingle of their
    prefixes; texts with equal sets are one node, and texts without words are alike.
    Groups of over 32 candidates under one key are compared along a forest of their nearest pairs first, and then in all
    pairs that the verified links have left in separate components. Rows without a doc_id take no part; rows that share
    one are one document.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("prefixes are short for similarities of 0.8 and more")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common, counts = common_shingles(rows, size)

    def over(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": batch.column(0), "fp": [], "same": [], "n": [], "bits": [], "prefix": []}
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, size)
            least = np.unique(hashes)
            out["fp"].append(fingerprint(hashes))
            out["same"].append(xxhash.xxh3_128_digest(least.tobytes()))
            out["n"].append(len(least))
            out["bits"].append(parity(least))
            out["prefix"].append(prefix(least, similarity, common, counts).view(np.int64))
        out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
        yield out

    prints = stored(mapped(rows, over, "doc_id long, fp long, same binary, n long, bits binary, prefix array<long>"))
    nodes = prints.groupBy("same").agg(F.min("doc_id").alias("node"), *(F.min(x).alias(x) for x in ("fp", "n", "bits", "prefix")))
    nodes = stored(nodes)
    def texts(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0), "packed": [zstandard.compress((x or "").encode(), 3) for x in batch.column(1).to_pylist()]}

    def compared(batch: pa.RecordBatch) -> Iterator[dict]:
        known: dict[int, np.ndarray] = {}  # of this slice: a text in many pairs is hashed once

        def shingles(doc_id: int, packed: bytes) -> np.ndarray:
            if doc_id not in known:
                known[doc_id] = np.unique(shingle_hashes(zstandard.decompress(packed).decode(), size))
            return known[doc_id]

        out: dict[str, list[int]] = {"a": [], "b": []}
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = shingles(a, x), shingles(b, y)
            shared = len(np.intersect1d(u, v, assume_unique=True))
            if shared >= similarity * (len(u) + len(v) - shared):
                out["a"].append(a)
                out["b"].append(b)
        yield out

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, by their whole texts, which travel compressed."""
        needed = kept_rows(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        found = stored(mapped(joined_by_id(rows, needed, "left_semi").dropDuplicates(["doc_id"]), texts, "doc_id long, packed binary"))
        left, right = (found.select(F.col("doc_id").alias(x), F.col("packed").alias("p" + x)) for x in "ab")
        return kept_rows(mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb"), compared, "a long, b long", 256))

    grid = stored(print_pairs(nodes))
    found = verified(grid)
    near = kept_rows(found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))  # one step: who has one neighbour is together
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    counts = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    # most shingles are in one prefix only; what is shared is a small part
    shared = joined_groups(entries, kept_rows(counts), "shingle", "rows")
    shared = shared.join(nodes.select("node", "fp"), "node").join(near, "node", "left")
    shared = stored(shared.withColumn("component", F.coalesce("component", "node")))
    columns = ["place", "node", "component", "fp", "n", "at"]

    def meet(keys: np.ndarray, node: np.ndarray, component: np.ndarray, fps: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[dict]:
        for a, b in close_pairs(keys, node, component, fps.view(np.uint64), n, at, similarity):
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    pairs = by_key(tiled(shared, "shingle", "node"), "place", columns, meet, "a long, b long").where("a <> b").distinct()
    pairs = stored(pairs.join(grid, ["a", "b"], "left_anti"))

    links = kept_rows(found.union(verified(pairs)))
    member = kept_rows(connected_components(links))
    crowded = shared.where(F.col("rows") > CROWD).drop("component").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowded = stored(crowded)
    apart = crowded.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    open_rows = crowded.join(apart, "shingle", "left_semi").join(nodes.select("node", "bits"), "node")

    def rest(keys: np.ndarray, node: np.ndarray, component: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray) -> Iterator[dict]:
        bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, 16)
        for a, b in cross_pairs(keys, node, component, n, at, bits, similarity):
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    more = by_key(tiled(open_rows, "shingle", "node"), "place", ["place", "node", "component", "n", "at", "bits"], rest, "a long, b long").where("a <> b")
    more = stored(more.distinct().join(pairs.union(grid), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        member = connected_components(links.union(verified(more)))
    classes = prints.groupBy("same").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    equal_sets = joined_groups(prints.select("doc_id", "same"), classes, "same", "copies")
    grouped = equal_sets.join(member, "node", "left").where("copies > 1 or component is not null")
    return grouped.select("doc_id", F.coalesce("component", "node").alias("component_id")).distinct()


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, without the documents that link, directly or through others, to one with a smaller doc_id."""
    gone = kept_rows(similar_groups(docs, size, similarity).groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id > c").select("doc_id"))
    return joined_by_id(docs, gone, "left_anti").select(docs.columns)
