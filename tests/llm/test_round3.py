"""Spelling variants, vector search and centroids against plain Python on small odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scholia.llm import kdtree, packing, spelling, tokens, vectors

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, word string, n long, form string, root string, id string"
VECTORS = "vec_id long, embedding array<float>, v string, id1 string, leaf int, cluster int, ids int"
rng = random.Random(11)
LONG = "".join(rng.choice("abcde") for _ in range(300))


def some_docs():
    base = ["stone", "stones", "storm", "river", "livers", "Großmutter", "élève", "élèves", "aaaaaa", "aaaaaaa", "aaaaa", "mill", "xy", "abcdef×ghij", LONG[:64], LONG[:65], LONG[:64] + "z"]
    base += [LONG, LONG[:150] + LONG[151:], LONG[:150] + "q" + LONG[151:], LONG[1:], "y" * 70, "y" * 71, "y" * 73]
    texts = []
    for i in range(40):
        words = [rng.choice(base) for _ in range(150)]
        texts.append((i, " ".join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in words) + ", stone-storm2stone_стone"))
    return [*texts, (40, None), (41, ""), (42, "·" * 5), (None, "stone stone element element element"), (7, "stone"), (7, "stone")]


def plainly(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    shorter, same = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :]].add(w)
            same[k, w[:k] + w[k + 1 :]].add(w)
    near = {w: (shorter[w] | {w[:k] + w[k + 1 :] for k in range(len(w))} & n.keys() | set().union(*(same[k, w[:k] + w[k + 1 :]] for k in range(len(w))))) - {w} for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) if x else None for w, x in near.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variants(spark, rows, monkeypatch=None):
    table = spark.createDataFrame([(i, t, "x", 1, "f", "r", "i") for i, t in rows], DOCS).repartition(3)
    return sorted(tuple(r) for r in spelling.group_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark, monkeypatch):
    rows = some_docs()
    expected = plainly(rows)
    assert any(len(w) > 64 and near for w, _, _, _, near, _ in expected) and any(f for _, f, *_ in expected)
    assert variants(spark, rows) == expected
    # Shards, broadcasts and blocks of states of any size give the same.
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 200)
    monkeypatch.setattr(spelling, "SENT", 2000)
    monkeypatch.setattr(spelling, "STATES", 8)
    assert variants(spark, rows) == expected


def test_no_variants(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, None), (None, ""), (2, "word word word")]) == []


def test_tries():
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))).encode() for _ in range(400)})
    trie = spelling.load(*spelling.build(words, list(range(1, len(words) + 1))).values())
    data, at = np.frombuffer(b"".join(words) + b"\0\0", np.uint8), np.cumsum([0, *map(len, words)])[:-1]
    own, node = spelling.one_edit(trie, data, at, np.array([len(w) for w in words]))
    found = list(zip([words[i].decode() for i in own], trie.spell(node), strict=True))

    def edits(w):
        return {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in ("", *"abc")} - {w}

    assert len(found) == len(set(found))
    assert set(found) == {(w.decode(), x) for w in words for x in edits(w.decode()) if x.encode() in set(words)}


def vector_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "v", "a", 1, 2, 3) for i, v in rows], VECTORS).repartition(3)


def nearest_plainly(rows):
    good = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = Counter()
    for a, (i, q) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), math.inf if j is None else j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
        for rank, (s, j) in enumerate(scored[:5]):
            out[i, rank + 1, None if j == math.inf else j, -s] += 1
    return out


def searched(spark, rows):
    return Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest_vectors(vector_table(spark, rows)).collect())


def test_nearest_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TARGET", 1.0)  # what isn't found by design has a test of its own
    g = np.random.default_rng(2)
    rows = [(i, g.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)] + [(50, rows[50][1]), (50, rows[50][1]), (100, g.normal(size=8).tolist()), (None, rows[50][1]), (None, rows[3][1])]
    rows += [(400, None), (450, []), (500, [0.0] * 8), (550, [1.0, None] * 4), (600, [math.nan] * 8), (650, [math.inf] * 8), (700, [1.0, 2.0]), (750, [2.0, 1.0]), (-50, rows[7][1]), (800, [3.0])]
    assert searched(spark, rows) == nearest_plainly(rows)
    assert searched(spark, []) == Counter() and searched(spark, [(50, [1.0, 2.0])]) == Counter() and searched(spark, [(51, [1.0, 2.0])]) == Counter()


def test_recall(spark):
    """Of a table with several leaves, shelves and a crowded vector nine tenths are found, each with its score."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * g.normal(size=16)).tolist()) for i in range(4000)] + [(i, centres[0].tolist()) for i in range(4000, 6000)]
    expected, got = nearest_plainly(rows), searched(spark, rows)
    by_pair = lambda c: {(q, v) for q, _, v, _ in c}
    assert sum(got.values()) == sum(expected.values())
    assert len(by_pair(expected) & by_pair(got)) >= 0.9 * len(by_pair(expected))


def test_tree_search_meets_all_leaves():
    g = np.random.default_rng(4)
    x = vectors.directions(g.normal(size=(3000, 12)))
    tree = vectors.fit(x)
    leaves = int(tree.leaf.max()) + 1
    assert leaves > 10 and sorted(vectors.visits(tree, x[0], 1 << 30)) == list(range(leaves))
    first = [vectors.visits(tree, q, 1)[0] for q in x[:200]]
    assert np.mean(vectors.place(tree, x[:200]) == first) > 0.95
    assert vectors.fit(np.ones((500, 4)) / 2).leaf.tolist() == [0]


def clustered_plainly(rows):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in v and all(map(math.isfinite, v))]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    z = [v for _, v in order[:16]]
    near = lambda v: min(range(len(z)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, z[j], strict=True)), j))
    for _ in range(3):
        own = [near(v) for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(z))]
        z = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else z[j] for j, m in enumerate(groups)]
    own = [near(v) for _, v in kept]
    d = [sum((a - b) ** 2 for a, b in zip(v, z[o], strict=True)) for (_, v), o in zip(kept, own, strict=True)]
    total = Counter()
    for o, x in zip(own, d, strict=True):
        total[o] += x
    return sorted(((i, o, x, total[o], sum(d), hashlib.sha256(",".join(map(str, z[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, d, strict=True)), key=str)


@pytest.mark.parametrize("scale", [0.1, 5.0, 1e5])
def test_clusters(spark, monkeypatch, scale):
    monkeypatch.setattr(kdtree, "CHUNK", 100)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    g = np.random.default_rng(5)
    rows = [(i, (scale * (g.normal(size=64) + 3 * (i % 5))).tolist()) for i in range(330)] + [(i, [scale] * 64) for i in range(330, 480)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [math.nan] * 64), (504, [math.inf] * 64), (505, [0.0] * 64), (506, [-0.0] * 64)]
    got = sorted((tuple(r) for r in kdtree.cluster_vectors(vector_table(spark, rows)).collect()), key=str)
    assert got == clustered_plainly(rows)


def test_few_vectors(spark):
    assert kdtree.cluster_vectors(vector_table(spark, [])).collect() == []
    rows = [(1, [1.0] * 64), (2, [2.0] * 64), (3, [1.0] * 64)]
    assert sorted((tuple(r) for r in kdtree.cluster_vectors(vector_table(spark, rows)).collect()), key=str) == clustered_plainly(rows)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        kdtree.cluster_vectors(vector_table(spark, [(1, [1e9] * 64)])).collect()


def test_whole_nodes_and_pruned_centroids():
    """Well-separated groups are assigned without looking at single vectors."""
    g = np.random.default_rng(6)
    z = np.array([[0] * 64, [1000] * 64, [-1000] * 64, [900] * 64])
    v = np.concatenate([c + g.integers(-5, 6, (512, 64)) for c in z[:2]]).astype(np.int64)
    order, levels = kdtree.build(v)
    found = list(kdtree.filtered(v[order].astype(np.int32), levels, z))
    assert sorted((j, b - a) for a, b, j, _ in found) == [(0, 512), (1, 512)]
    for a, b, _, sums in found:
        assert (sums == v[order[a:b]].sum(0)).all()


def test_encoder_with_a_full_table(monkeypatch):
    """Units met before, a table without room, long units and blank ones give the library's ids."""
    monkeypatch.setattr(tokens, "KEEP_UNITS", 40)
    enc, rng = tokens.Encoder(tokens.vocabulary()), random.Random(3)
    words = ["".join(rng.choice("abcdeéß漢1-") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    for _ in range(4):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "\n", " ", "\nx", "  y"]) for _ in range(30)]
        flat, ends = enc.encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(flat, ends[:-1])]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < enc.known.n <= 40
    flat, ends = enc.encode(pa.array([], pa.string()))
    assert not len(flat) and not len(ends)


def test_known_units_keep_one_of_equal_hashes():
    known = tokens.Known(10, wide=True)
    fits, words, hashes = known.keys(pa.array([" a", "b", "", "x" * 17]))
    assert fits.tolist() == [True, True, True, False]
    hashes[:2] = 7
    known.add(words[:3], hashes[:3], np.array([5, 6, 7], np.uint32), np.array([2, 1, 0]))
    place = known.find(words[:3], hashes[:3])
    assert place[0] >= 0 and place[1] == -1 and place[2] >= 0
    assert known.ids[known.starts[place[0]] :][: known.sizes[place[0]]].tolist() == [5, 6]
    known.add(words[1:2], hashes[1:2], np.array([6], np.uint32), np.array([1]))
    assert known.n == 2


def test_the_slots_of_packing_need_no_python_workers(spark):
    """A list of rows is read by a second pool of Python workers on each executor, which stays beside the first."""
    docs = spark.createDataFrame([(i, "a word " * (300 * i)) for i in range(8)] + [(8, None)], "doc_id long, text string")
    packed = packing.pack_documents(docs)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(range(9)) and max(r.offset + r.length for r in rows) <= packing.SEQUENCE
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_freed_memory_goes_back():
    """What texts took while they were worked on doesn't stay with the worker, and a slice is small."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) / 1024

    enc, rng = tokens.Encoder(tokens.vocabulary()), random.Random(5)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(str(rng.getrandbits(60)) for _ in range(4000)) for _ in range(150)])], names=["text"])
    slices = []
    before = held()
    for rows, texts in tokens.text_batches(batch):
        slices.append(texts.nbytes)
        enc.encode(texts)
    del rows, texts
    tokens.give_back()
    assert max(slices) < 1.2 * (1 << 20) and held() - before < 100
