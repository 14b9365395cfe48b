"""The language model: counts, base and score against a version without Spark or arrays; distributions; independence of partitions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from loomwright.llm import mixing


def documents(n=260):
    rng = random.Random(11)
    parts = ["an", "ti", "on", "re", "the", "st", "ou", "ble"]
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    docs = [(i, " ".join(word().capitalize() if rng.random() < 0.1 else word() for _ in range(rng.randint(5, 120)))) for i in range(n)]
    docs += [(n + 10 + i, docs[i][1]) for i in range(20)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "é É Zebra zebra x9 x9 x9"), (n + 3, "unseen" * 30)]


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def counts_and_base(docs):
    counts = Counter(w for d, t in docs if not held(d) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (held(d), len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t))) for d, t in docs}


def h(word):
    return xxhash.xxh64_intdigest(word, 42) if word else int(mixing.EDGE)


def mixed(x):
    return int(mixing.mixed_hash(np.array([x % 2**64], np.uint64))[0])


def brute_scores(docs, alphabet):
    """The model token by token: counts in dictionaries, one choice after another; one lane."""
    counts = Counter(w for d, t in docs if not held(d) for w in tokens_of(t))
    names = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c > 1][:alphabet]
    place = {w: k for k, w in enumerate(names)}
    tail = [w for w in counts if w not in place]
    tokens, types = [sum(counts[w] for w in tail if mixing.shape(w) == k) for k in range(32)], [sum(mixing.shape(w) == k for w in tail) for k in range(32)]
    code, length = mixing.huffman(np.array([counts[w] for w in names] + tokens, float))
    path = lambda leaf: [int(code[leaf]) >> (63 - i) & 1 for i in range(length[leaf])]
    tree = Counter()
    for leaf, c in enumerate([counts[w] for w in names] + tokens):
        for i in range(length[leaf] + 1):
            tree[tuple(path(leaf)[:i])] += max(c, 0.5)
    events, seen = [], defaultdict(int)
    for d, text in docs:
        words = tokens_of(text)
        digest = xxhash.xxh64_intdigest((text or "").encode(), 42) % 2**32 if text is not None else 42
        used, last = Counter(), 255
        for i, w in enumerate(words):
            leaf = place.get(w, len(names) + mixing.shape(w))
            b, s = (words[i - 1] if i else None), (words[i - 2] if i > 1 else None)
            one, two = h(b) >> 40, mixed(h(b) + h(s) * int(mixing.ODD)) >> 40
            key = (mixed((d + digest * int(mixing.ODD)) * int(mixing.ODD2) + (one << 24 | two)) + leaf * int(mixing.ODD)) % 2**64
            share = 15 * i // (i + 50)
            own = 0.3 / 15 * share * used[w] / max(i, 1)
            own = 1 + math.ceil(-10 * math.log2(own / 0.3) - 1e-9) if own else 0
            name = None
            label = h(w) >> 32 | 1 if w not in place and used[w] else 0
            key = (key + (label << 16 | share << 8 | own) * int(mixing.EDGE)) % 2**64
            if w not in place and used[w]:
                k, rest = mixing.shape(w), max(counts[w] - (0 if held(d) else words.count(w)), 0)
                name = math.log10((rest - 0.75 if rest else 0.75 * types[k]) / tokens[k]) if tokens[k] else 0
            events.append((key, share, own, d, name, leaf, one, two, last if i else 255))
            used[w] += 1
            last = leaf if leaf < min(255, len(names)) else last
    for _, _, _, d, _, leaf, one, two, company in events:
        for i in range(length[leaf] + 1):
            for context in (("c", company, one % mixing.PARTS), ("o", one), ("t", one, two % 2**22)):
                seen[context, tuple(path(leaf)[:i])] += not held(d)
    total = Counter()
    for part in range(mixing.PARTS):
        mixed_part(sorted((e for e in events if e[6] % mixing.PARTS == part), key=lambda e: (*e[:3], e[4] or 0)), seen, tree, path, length, total)
    for d, text in docs:
        for w, n in Counter(tokens_of(text)).items():
            if w not in place:
                k = mixing.shape(w)
                rest = max(counts[w] - (0 if held(d) else n), 0)
                share = (rest - 0.75 if rest else 0.75 * types[k]) / tokens[k] if tokens[k] else 1
                total[d] += math.log10(share)
    return total


def mixed_part(events, seen, tree, path, length, total):
    mixer, step = mixing.Mixer.new(), mixing.FIRST
    while events:
        rows, gates, learns, owner = [], [], [], []
        taught = [k for k, e in enumerate(events) if not held(e[3])][: step + 1]
        stop = taught[step] if len(taught) > step else len(events)
        batch, events = events[:stop], events[stop:]
        if len(taught) > step:  # held-out events up to the next one to learn from belong to its batch
            while batch and held(batch[-1][3]):
                events.insert(0, batch.pop())
        for number, (_, _, _, d, _, leaf, one, two, company) in enumerate(batch):
            less, bits = not held(d), path(leaf)
            for i in range(length[leaf]):
                here, there = tuple(bits[:i]), tuple(bits[: i + 1])
                p = max(tree[there] - less, 0.25) / max(tree[here] - less, 0.5)
                x, found = [p], []
                for context, back in zip((("c", company, one % mixing.PARTS), ("o", one), ("t", one, two % 2**22)), mixing.BACK):
                    whole, taken = seen[context, here] - less, seen[context, there] - less
                    p = (taken + back * p) / (whole + back)
                    x.append(p)
                    found.append((whole, taken))
                step_of = lambda edges, v: sum(v > e for e in edges)
                (w1, _), (w2, t2) = found[1:]
                gates.append(((step_of([0.5, 3.5, 31.5], w1) * 4 + step_of([0.5, 1.5, 7.5], w2)) * 2 + (0 < t2 < w2)) * 4 + step_of([0.5, 3.5, 8.5], i))
                rows.append([math.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6))) for q in x])
                learns.append(less)
                owner.append(number)
        logs = mixer.log10(np.array(rows, np.float32).T, np.array(gates), np.array(learns))
        sums = np.bincount(owner, logs, len(batch))
        for (_, share, own, d, name, *_), log in zip(batch, sums):
            own, share = 0.3 * 2 ** ((1 - own) / 10) if own else 0, share * 0.3 / 15
            total[d] += math.log10((1 - share) * 10 ** (log + (name or 0)) + own)
        step = min(2 * step, mixing.LAST)


@pytest.mark.parametrize("alphabet", [20, 100_000])
def test_scores_against_brute_force(spark, alphabet):
    docs = documents()
    rows = mixing.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), alphabet=alphabet).collect()
    want, brute = counts_and_base(docs), brute_scores(docs, alphabet)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(brute[r.doc_id], rel=1e-4)
        assert r.bits_per_byte > 0 and math.isfinite(r.bits_per_byte)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    totals = {r.held_out: r for r in mixing.total_bits_per_byte(spark.createDataFrame(rows)).collect()}
    assert totals[True].documents == len(unseen) and 0 < totals[True].bits_per_byte < 8


def test_scores_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(documents(), "doc_id long, text string")
    results = []
    for parts, shuffles in ((1, 1), (7, 5)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        results.append({r.doc_id: r.score for r in mixing.score_documents(frame.repartition(parts), lane=1500).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0].keys() == results[1].keys()
    assert all(results[0][d] == pytest.approx(results[1][d], rel=1e-9) for d in results[0])


def test_lanes_keep_every_event():
    seen = np.array([4000, 300, 2])
    model = mixing.Model([b"the", b"\n", b"of"], seen, np.zeros((2, 32)), mixing.spelling_table(np.zeros(mixing.SPELLED)), 4302, 3, 9, 500).prepare()
    texts = ["the of " * 40] * 30 + ["", None, "new words"]
    pieces = list(mixing.Reader(model).block(list(range(33)), np.zeros(33, np.int64), np.zeros(33, bool), texts))
    events = [len(mixing.unpacked(data, "u2", "u4", "u4", "u4", "u1", "u1", "u1", "u4")[0]) for _, kind, _, data, _ in pieces if kind == 0]
    assert sum(events) == sum(len(tokens_of(t)) for t in texts) and max(events) < 1600
    assert {lane for lane, *_ in pieces} <= set(range(9))


def test_probabilities_of_all_leaves_sum_to_one():
    rng = np.random.default_rng(5)
    n = 50
    model = mixing.Model([b"%d" % k for k in range(n)], np.sort(rng.integers(2, 300, n))[::-1], np.zeros((2, 32)), mixing.spelling_table(np.zeros(mixing.SPELLED)), 1, 1, 1, 1).prepare()
    leaf = np.concatenate([rng.integers(0, n, 3000), np.arange(n + mixing.CLASSES)])
    learns = np.arange(len(leaf)) < 3000
    where = np.where(learns, rng.integers(0, 4, len(leaf)), 2)
    logs = mixing.lane_scores(model, where.astype(np.uint32), (where % 2).astype(np.uint32), (where // 2).astype(np.uint8), leaf, learns)
    assert (10 ** logs[~learns]).sum() == pytest.approx(1, abs=1e-4)


def test_names_in_a_class_and_spellings_sum_to_at_most_one():
    classes = np.zeros((2, 32))
    classes[:, 3] = 10, 4
    model = mixing.Model([], np.zeros(0, np.int64), classes, mixing.spelling_table(np.random.default_rng(1).integers(0, 3, mixing.SPELLED).astype(float)), 10, 4, 1, 1)
    shares = 10 ** model.named(np.full(5, 3), np.array([4, 3, 2, 1, 0]))
    assert shares.sum() == pytest.approx(1)
    each = [bytes([b]) for b in range(256)]
    assert sum(10 ** (model.spelled(each) - model.spelled([b + b"\x00" for b in each]) + model.spelled([b + b"\x00" for b in each]))) <= 1 + 1e-6


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a b", 5.0, 1), (1, "a b", 5.0, 1), (None, "a", 6.0, 2), (2, None, 0.0, 3), (3, "x " * 30_000, 0.0, 3)], "doc_id long, text string, score double, lane int")
    rows = mixing.score_documents(frame).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 3, 3, 30_001]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert mixing.score_documents(frame.where("false")).collect() == []


def test_scores_do_not_depend_on_held_out_documents(spark):
    docs = documents()
    out_of_sample = [d for d, _ in docs if held(d)]
    gone = set(out_of_sample[::2])
    score = lambda rows: {r.doc_id: (r.score, r.bits_per_byte) for r in mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), alphabet=20).collect()}
    whole, part = score(docs), score([d for d in docs if d[0] not in gone])
    assert len(gone) > 10 and part.keys() == whole.keys() - gone
    assert all(part[d] == pytest.approx(whole[d], rel=1e-9) for d in part)


def test_repeated_words_share_one_probability(spark):
    """Whatever follows a rare word: the word again, siblings of its class and the rest together are at most certain."""
    alphabet, docs = 20, documents()
    learnt = Counter(w for d, t in docs if not held(d) for w in tokens_of(t))
    top = [w for w, c in sorted(learnt.items(), key=lambda x: (-x[1], x[0])) if c > 1][:alphabet]
    rare = [w for w in learnt if w not in top]
    start = 10_000
    probes = [[rare[0], w] for w in [*rare, *(w for w in top if w != b"\n")]]
    ids = [i for i in range(start, start + 100 * len(probes)) if held(i)][: len(probes) + 1]
    rows = docs + [(i, b" ".join(p).decode()) for i, p in zip(ids, probes)] + [(ids[-1], rare[0].decode())]
    scored = {r.doc_id: r.score for r in mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), alphabet=alphabet).collect()}
    again = scored[ids[0]]
    siblings = [scored[i] for i, p in zip(ids, probes) if p[1] != p[0] and p[1] in rare and mixing.shape(p[1]) == mixing.shape(p[0]) and learnt[p[1]] == learnt[p[0]]]
    assert siblings and again < max(siblings) + 1  # no more than the same name and path; the end after it differs little


def test_counts_are_of_the_whole_corpus(spark, monkeypatch):
    """With weights that stand still, scores follow from counts alone: they are equal however many lanes share the work."""
    monkeypatch.setattr(mixing, "RATE", 0.0)
    monkeypatch.setattr(mixing, "PRIOR", 1e15)
    docs = documents()
    counts = Counter(w for d, t in docs for w in tokens_of(t) if not held(d))
    every = pa.table({"word": [w.decode() for w in counts], "seen": list(counts.values())})
    words = mixing.stored(mixing.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), 7))
    ids, texts = zip(*docs, strict=True)
    digests = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts], np.uint64).view(np.int64)

    def grouped(table, key):
        return {k: table.filter(pc.equal(table.column(key), k)) for k in set(table.column(key).to_pylist())}

    def scores(lane, tasks):
        model = mixing.fit(words, lane=lane).prepare()
        pieces = list(zip(*mixing.Reader(model).block(list(ids), digests, np.array([held(d) for d in ids]), list(texts)), strict=True))
        lanes = grouped(pa.table(dict(zip(("lane", "kind", "docs", "data", "words"), map(list, pieces), strict=True))), "lane")
        asked = pa.concat_tables(mixing.lane_requests(model, tasks, k, some) for k, some in lanes.items())
        told = pa.concat_tables(mixing.whole_counts(model, some) for some in grouped(asked, "task").values())
        others = pa.concat_tables([every, told.drop_columns("lane")], promote_options="default")
        mine = lambda k: others.filter(pc.fill_null(pc.equal(pc.divide(others.column("who"), mixing.PARTS), k), True))
        sums = pa.concat_tables(mixing.lane_sums(model, 1, tasks, some, mine(k)) for k, some in lanes.items())
        found = mixing.document_sums(sums)
        return model, lanes, dict(zip(found.column("doc_id").to_pylist(), found.column("mixed").to_pylist(), strict=True))

    (_, one, whole), (model, many, parted) = scores(1_000_000, 1), scores(1500, 3)
    assert len(one) == 1 and len(many) > 5 and (mixing.Reader(model).parts > 1).sum() > 3
    assert whole.keys() == parted.keys() == set(ids)
    assert all(parted[d] == pytest.approx(whole[d], rel=1e-5) for d in ids)


def test_words_are_what_lies_between_spaces():
    texts = [" a  B\t", None, "", " \n\r\x0b\x0c ", "É x y z\x1cZ", "one", "x" * 40 + "\nÀ9 9 -"]
    sizes, words = mixing.words_in(pa.chunked_array([pa.array(["left out", *texts])[1:]]).combine_chunks())
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == list(map(len, want)) and words.cast(pa.large_binary()).to_pylist() == sum(want, [])
    kind = lambda w: 0 if w.isalpha() else 1 if not w.isascii() else 2 if any(48 <= b < 58 for b in w) else 3
    assert mixing.shapes_of(words).tolist() == [kind(w) * 8 + min(7, len(w).bit_length()) for w in sum(want, [])]
    assert mixing.strings_of(words) == sum(want, []) and mixing.strings_of(words[:0]) == []


def test_what_is_shuffled_for_a_token_is_small():
    """Words before an event go as ranks of the alphabet, and sums with ids alone: 7.1 and 1.1 bytes a token before that."""
    rng = np.random.default_rng(3)
    counts = np.sort(rng.zipf(1.3, 20_000).clip(2, 50_000))[::-1].astype(np.int64)
    names, n = [b"w%x" % k for k in range(len(counts))], int(counts.sum())
    model = mixing.Model(names, counts, np.zeros((2, 32)), mixing.spelling_table(np.zeros(mixing.SPELLED)), n, len(counts), 20, n).prepare()
    model.repeated = np.zeros(1 << 20, bool)
    texts = [" ".join(names[k].decode() for k in rng.choice(len(names), 300, p=counts / n)) for _ in range(600)]
    digests = rng.integers(-(2**63), 2**63, len(texts))
    lanes: dict[int, list] = {}
    for piece in mixing.Reader(model).block(list(range(len(texts))), digests, np.zeros(len(texts), bool), texts):
        lanes.setdefault(piece[0], []).append(piece)
    tables = [pa.table(dict(zip(("lane", "kind", "docs", "data", "words"), map(list, zip(*p, strict=True)), strict=True))) for p in lanes.values()]
    tokens, size = 301 * len(texts), lambda t, c: sum(len(x.as_py()) for x in t.column(c))
    assert sum(size(t, "data") for t in tables) / tokens < 6.4
    others = pa.table({"word": pa.array([], pa.string()), "seen": pa.array([], pa.int64())})
    table = tables[0]
    asked = mixing.lane_requests(model, 1, 0, table)
    told = pa.concat_tables(mixing.whole_counts(model, asked.filter(pc.equal(asked.column("task"), k))) for k in set(asked.column("task").to_pylist()))
    sums = mixing.lane_sums(model, 1, 1, table, pa.concat_tables([others, told.drop_columns("lane")], promote_options="default"))
    events = sum(len(mixing.unpacked(d.as_py(), *mixing.EVENT)[0]) for k, d in zip(table.column("kind").to_pylist(), table.column("data")) if k == 0)
    assert size(sums, "data") / events < 0.85


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(i, t) for i, t in documents() if t] + [(3, "quite another text"), (3, "and a third one of six words"), (3 + (1 << 20), "alone")]
    scored = mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), lane=1500).collect()
    want = Counter((d, len(tokens_of(t))) for d, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in scored) == want and all(r.score < 0 for r in scored)
