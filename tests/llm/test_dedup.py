"""The three near-duplicate operators against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import embed_dedup, induced_sort, ngram_join, suffix_dedup
from tidemark.llm.induced_sort import InducedSort

WORDS = ["the", "of", "and", "ra", "thiné", "ono", "ly", "Est", "mi", "co"]


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(n)]
    passage, out = prose(rng, 60), []
    for text in base:
        out.append(text)
        if rng.random() < 0.3:
            out.append(text)
        if rng.random() < 0.5:
            words = text.split(" ")
            for _ in range(rng.randint(1, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = "zz"
            out.append(" ".join(words))
        if rng.random() < 0.3:
            out.append(prose(rng, rng.randint(0, 9)) + "\n" + passage + prose(rng, rng.randint(0, 9)))
    out += [None, "", " \t\n ", "a", "a", "ab " * 300, "x" * 500, "one two three", "ONE two\tthree", out[0] + out[3]]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out, strict=True))


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


@pytest.mark.parametrize(("chunk", "part"), [(2048, 512), (3, 2)])
def test_ngram_join(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(ngram_join, "ROWS", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closure(sets, links)
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert len(set(root.values())) < len(root)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(root.values())


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (400, ngram_join.GROUPS))
    points[200:] = points[:200] + (rng.random((200, ngram_join.GROUPS)) < 0.05)
    sizes, group = points.sum(1), rng.integers(0, 3, 400)
    got = [p for q, e in ngram_join.CountTree(group, points, sizes).search(80, lambda q, e: q < e) for p in zip(q.tolist(), e.tolist(), strict=True)]
    bound = np.minimum(points[:, None], points[None]).sum(2)
    low, high = np.minimum(sizes[:, None], sizes[None]), np.maximum(sizes[:, None], sizes[None])
    want = np.argwhere((bound >= ngram_join.needed(sizes[:, None], sizes[None], 80)) & (100 * low >= 80 * high) & (group[:, None] == group) & (np.arange(400)[:, None] < np.arange(400)))
    assert sorted(got) == sorted(map(tuple, want.tolist())) and got


def test_ngram_join_repeated_rows(spark):
    rng, rows = random.Random(11), []
    for k in range(20):  # two linked texts that share one shingle of their prefixes, with a smaller document apart from both
        words = ["".join(rng.choices("bcdfghjk", k=8)) for _ in range(9)]
        short = words[:8]
        least = ngram_join.shingles(np.frombuffer(" ".join(short).encode(), np.uint8))[0]
        alone = next(" ".join(short[i : i + 5]) for i in range(4) if ngram_join.shingles(np.frombuffer(" ".join(short[i : i + 5]).encode(), np.uint8))[0] == least)
        rows += [(3 * k, alone), (3 * k + 1, " ".join(words)), (3 * k + 2, " ".join(short))]
    want = sorted([(3 * k + d, n, 3 * k + (d > 0)) for k in range(20) for d, n in enumerate((1, 5, 4))] * 2)
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.classes(df).collect()) == want
    assert sorted(tuple(r) for r in ngram_join.one_of_each(df).collect()) == sorted([r for r in rows if r[0] % 3 < 2] * 2)


def test_ngram_join_odd_ids(spark):
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1])
    rows = [(7, one), (9, near), (9, other), (4, other), (None, near), (None, "alone here"), (None, None), (None, "alone here"), (5, ""), (5, "five")]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n int, digest string")
    want = [(7, 56, 7), (9, 56, 7), (9, 56, 4), (4, 56, 4), (None, 56, 7), (None, 1, None), (None, 0, None), (None, 1, None), (5, 0, 5), (5, 1, 5)]
    assert sorted(map(str, (tuple(r) for r in ngram_join.classes(df).collect()))) == sorted(map(str, want))
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(7, one), (4, other), (None, "alone here"), (None, None), (None, "alone here"), (5, ""), (5, "five")]))


def test_ngram_join_empty(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def cut(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        x = (text or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            part = x[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("group", "memory", "length"), [(2048, 64 << 20, 100), (1, 1, 100), (2048, 300, 20), (2, 64 << 20, 20)])
def test_suffix_dedup(spark, monkeypatch, group, memory, length):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "MEMORY", memory)
    rows = corpus(2)
    df = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, doc string")
    got = {r.doc_id: tuple(r._cut[:3]) + (hashlib.sha256(r._cut.kept).hexdigest(),) for r in suffix_dedup.remove_repeated(df, length).collect()}
    assert got == cut(rows, length)
    out = suffix_dedup.without_repeats(df, length)
    assert out.columns == df.columns and out.count() == len(rows)


def test_suffix_dedup_short_periods(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choices("bcdfghjklmnpqrstvwxyz ", k=n))
    texts = []
    for n in range(101, 151):
        unit = "".join(rng.choices("AEIOU-=", k=rng.randint(1, 7)))
        texts.append(line(rng.randint(60, 90)) + (unit * n)[:n] + line(rng.randint(60, 90)))
        texts.append(line(70) + texts[-1][20:-20] + line(70))
    texts += [line(80) + "-" * 120 + line(80), line(80) + "ha ha " * 21 + line(80), line(80) + "Heer " * 23 + line(80)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r._cut[:3]) + (hashlib.sha256(r._cut.kept).hexdigest(),) for r in suffix_dedup.remove_repeated(df).collect()}
    assert got == cut(rows, 100)


def test_fragments_that_repeat_themselves():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = np.concatenate([np.tile(rng.integers(97, 123, rng.integers(1, 60)).astype(np.uint8), rng.integers(1, 30))[: rng.integers(1, 300)] for _ in range(4)])
        for k in suffix_dedup._levels(100):
            found = list(zip(*suffix_dedup.fragments(x, 100, k), strict=True))
            assert [s for _, start, count, _ in found for s in range(start, start + count)] == list(range(len(x) - 99))
            for _, start, count, again in found:
                own = [x[s : s + 100].tobytes() for s in range(start, start + count)]
                assert again or len(set(own)) == len(own)


def test_suffix_dedup_odd_ids(spark):
    rng = random.Random(19)
    line = lambda n: "".join(rng.choices("bcdfghjklmnpqrstvwxyz ", k=n))
    passage = line(150)
    texts = [passage, line(60) + passage, line(10) + passage + line(5)]
    rows = [(3, texts[0]), (3, texts[1]), (3, texts[1]), (1, texts[2]), (None, passage), (None, None), (4, None), (4, "")]
    got = sorted((str(r.doc_id), str(r.text), tuple(r._cut[:3]) + (hashlib.sha256(r._cut.kept).hexdigest(),)) for r in suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = cut([(i, t) for i, (_, t) in enumerate(order)], 100)
    told = {r: want[i] for i, r in enumerate(order)} | {(None, t): cut([(0, t)], 100)[0] for t in (passage, None)}
    assert got == sorted((str(d), str(t), told[d, t]) for d, t in rows)


def test_induced_sort_beyond_memory(monkeypatch):
    """Arrays and queues on disk, names sorted by recursion; less than the text is held at once."""
    import tracemalloc

    monkeypatch.setattr(induced_sort, "BLOCK", 1 << 11)
    rng = random.Random(20)
    vocab = [prose(rng, 1) for _ in range(3000)]
    text = np.frombuffer(b"\0".join(" ".join(rng.choices(vocab, k=300)).encode() for _ in range(800)) + b"\0", np.uint8)
    tracemalloc.start()
    total = sum(len(at) for at, _ in InducedSort(text, 100, 1 << 16, 1 << 11).sorted())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(text) - 800 and peak < len(text), (peak, len(text))


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("memory", "block", "width", "look"), [(1, 3, 4096, 4096), (300, 7, 4096, 2), (3000, 1 << 16, 1, 4096), (3000, 50, 3, 5), (1 << 20, 1 << 16, 4096, 4096)])
def test_induced_sort(monkeypatch, memory, block, width, look):
    """Down to one suffix a range, names with a queue of their own, all levels by recursion; and doubling in memory."""
    monkeypatch.setattr(induced_sort, "WIDTH", width)
    monkeypatch.setattr(induced_sort, "LOOK", look)
    rng = random.Random(5)
    for _ in range(15):
        letters, cap = rng.choice([1, 2, 3, 26]), rng.choice([3, 10, 100])
        parts = [bytes(rng.choice(range(1, 1 + letters)) for _ in range(rng.randint(1, rng.choice([3, 40, 300])))) for _ in range(rng.randint(1, 8))]
        parts += [parts[0], parts[-1] * 3]
        text = b"\0".join(parts) + b"\0"
        got = [(int(p), int(n)) for at, common in InducedSort(np.frombuffer(text, np.uint8), cap, memory, block).sorted() for p, n in zip(at, common, strict=True)]
        suffix = lambda p: text[p : text.index(0, p)]  # noqa: B023, E731
        assert sorted(p for p, _ in got) == [p for p, c in enumerate(text) if c]
        for (p, _), (q, n) in zip(got[:-1], got[1:], strict=True):
            a, b = suffix(p), suffix(q)
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a[:cap] <= b[:cap] and n == min(cap, same)


@pytest.mark.parametrize(("chunk", "wide"), [(4096, 1 << 13), (4, 1 << 13), (4096, 1)])
def test_embedding_dedup(spark, monkeypatch, chunk, wide):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embed_dedup, "WIDE", wide)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        v, label = rng.normal(size=24), int(rng.integers(0, 3))
        rows += [(v + rng.normal(size=24) * rng.choice([0, 0.05, 0.2]), label) for _ in range(rng.integers(1, 5))]
    v = rng.normal(size=24)  # right at the limit, to the last digits
    u = rng.normal(size=24)
    u -= v * (u @ v) / (v @ v)
    rows += [(v, 1)] + [(v / np.linalg.norm(v) * c + u / np.linalg.norm(u) * np.sqrt(1 - c * c), 1) for c in (0.97999, 0.98, 0.98001, 0.9799999, 0.9800001)]
    rows += [(rows[0][0], rows[0][1]), (rows[0][0] * 3, rows[0][1]), (rows[0][0], None), (np.zeros(24), 1), (np.full(24, np.nan), 1), (np.full(24, np.inf), 1), (None, 1), ([1.0, None], 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, 7) for i, (v, label) in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep int")
    sound = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = []
    for i, v, a, _ in data:
        for j, w, b, _ in data:
            if i < j and a == b and a is not None and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    root = closure(range(len(data)), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (sum(i in p for p in links), root[i], root[i] == i) for i in range(len(data))}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_odd_ids(spark):
    data = [(5, [1.0, 0.0], "a"), (5, [0.0, 1.0], "a"), (7, [0.0, 1.0], "a"), (None, [1.0, 0.01], "a"), (None, [1.0, 1.0], "a"), (None, [1.0, 1.0], None), (3, [1.0, 0.02], "b"), (3, [1.0, 0.02], "b"), (4, [-1.0, 0.0], "a")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 1, 5, False), (None, 0, None, True), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)], key=str)


def test_visits_meet_all_within_reach():
    rng = np.random.default_rng(6)
    for depth in (1, 2, 5):
        q = rng.integers(-90, 90, (300, depth))
        row, cell, guest = embed_dedup.visits(q, 400)
        at = {}
        for r, c, g in zip(row.tolist(), map(tuple, cell.tolist()), guest.tolist(), strict=True):
            at.setdefault(c, ([], []))[g].append(r)
        met = [tuple(sorted(p)) for own, guests in at.values() for i, a in enumerate(own) for p in [(a, b) for b in own[i + 1 :] + guests]]
        near = {(a, b) for a in range(300) for b in range(a + 1, 300) if ((q[a] - q[b]) ** 2).sum() <= 400}
        assert near <= set(met) and len(met) == len(set(met))
        assert len(row) <= 300 * (1 + 3 * depth)


def test_workers_give_memory_back(spark):
    """Spark keeps idle Python workers; what a task took must not stay with them."""
    import pyarrow as pa

    from tidemark.llm.repeated import repeated

    def held(batches):
        list(batches)
        with open("/proc/self/smaps_rollup") as f:
            yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10])], ["mb"])

    def entries(batch):
        for i in batch.column(0).to_pylist():
            rng = np.random.default_rng(i)
            for _ in range(8):
                yield rng.integers(0, 2**63, 1 << 14, np.uint64), np.arange(1 << 14), np.arange(1 << 14)

    most = lambda: max(r.mb for r in spark.range(0, 8, 1, 4).mapInArrow(held, "mb long").collect())
    before = most()
    assert repeated(spark.range(0, 64, 1, 4), entries).count() == 0
    assert most() < before + 60
