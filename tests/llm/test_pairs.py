"""Operators on pairs against brute force."""

from collections import Counter

import numpy as np
import pytest

from tallystone.llm import dart_minhash as dm
from tallystone.llm import euclidean_lsh as el


def roots(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            own = out[rng.integers(len(out))].split(" ")
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(len(own))] = words[rng.integers(400)]
        else:
            own = [words[j] for j in rng.integers(0, 400, rng.integers(1, 200))]
        out.append(" ".join(own))
    return out


def cells(text):
    return np.sort(dm.unit_cells(dm.shingles(text)))


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dm, "BLOCK", block)
    own = texts(3) + ["a b", "a b", "", None, " \n", "a b c d e f g h i j", "a b c d e f g h i j"]
    rows = [(i, t, "clash") for i, t in enumerate(own)] + [(None, "a b", "clash"), (0, own[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    sets = [Counter(dm.shingles(t).tolist()) for t in own]
    for i, a in enumerate(sets[:20]):
        for j, b in enumerate(sets[:20]):
            assert dm.similarity(cells(own[i]), cells(own[j])) == ((a & b).total() / (a | b).total() if a else 0)
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total() > 0]
    want = roots(range(len(own)), pairs)
    found = dm.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert got == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)
    assert len(set(want.values())) < len(own) - 20
    kept = dm.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_unrelated_texts_of_one_doc_id_are_both_kept(spark):
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, own[0]), (2, own[0]), (1, own[1]), (1, own[1]), (3, own[1] + " more"), (4, own[2])]
    kept = dm.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, own[0]), (1, own[1]), (4, own[2])]


def test_no_rows(spark):
    assert dm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert el.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("columns", [1 << 14, 7])
def test_links_of_a_block(monkeypatch, columns):
    monkeypatch.setattr(dm, "COLUMNS", columns)
    own = [cells(t) for t in texts(8)]
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if dm.similarity(own[i], own[j]) >= 0.8}
    assert set(zip(*(x.tolist() for x in dm.links(own, 0.8)), strict=True)) == want and len(want) > 10


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = np.concatenate([a, a[:100], a[:50]])
    b = np.concatenate([a[60:], rng.integers(0, 2**63, 60).astype(np.uint64)])
    sig = dm.signatures([dm.unit_cells(a), dm.unit_cells(b)], 4000)
    true = dm.similarity(np.sort(dm.unit_cells(a)), np.sort(dm.unit_cells(b)))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    alone = dm.signatures([dm.unit_cells(a)], 4000)
    assert (alone[0] == sig[0]).all()


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(el, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 24))
    x[100:180] = x[0] + rng.standard_normal((80, 24)) * 0.2
    x[180:220] = x[rng.integers(0, 100, 40)] * 3
    x[220:260] = x[220] + np.cumsum(rng.standard_normal((40, 24)) * 0.09, axis=0)
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [1.0, None]), (304, []), (305, [float(v) for v in x[7]]), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(i, j) for i in full for j in full if i < j and len(full[i]) == len(full[j]) and full[i] @ full[j] / np.linalg.norm(full[i]) / np.linalg.norm(full[j]) >= 0.95]
    want, links = roots([i for i, _ in rows], pairs), Counter([k for p in pairs for k in p])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in el.near_duplicates(vectors).collect()}
    wrong = [i for i, _ in rows if got[i] != (links[i], want[i], want[i] == i)]
    assert not wrong, [(i, got[i], links[i], want[i]) for i in wrong[:5]]
    assert len(pairs) > 1000


def test_vectors_of_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 7, "x"), (5, [1.0, 0.0], 8, "x"), (5, [2.0, 0.0], 9, "x"), (6, [0.0, 3.0], 9, "x"), (None, None, 1, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long, n string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in el.near_duplicates(vectors).collect()))
    assert got == [(0, 0, 0, True), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True)]


def test_cosines_at_the_limit_link(spark):
    # 0.95 = 19 / 20: norms 20 and 20, dot product 380
    rows = [(0, [20.0, 0.0, 0.0]), (1, [19.0, 39.0**0.5, 0.0]), (2, [18.999, 0.0, (400 - 18.999**2) ** 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(i, j): np.dot(a, b) / (np.dot(a, a) ** 0.5 * np.dot(b, b) ** 0.5) >= 0.95 for i, a in rows for j, b in rows if i < j}
    got = {r.vec_id: r.n_links for r in el.near_duplicates(vectors).collect()}
    assert got == {i: sum(on for p, on in want.items() if i in p) for i, _ in rows}


def test_pairs_at_the_limit_meet():
    """Recall of the hashing alone, for the parameters of fifty thousand vectors and of a hundred million."""
    rng = np.random.default_rng(3)
    x = el.unit(rng.standard_normal((1500, 64)))
    side = rng.standard_normal((1500, 64))
    side = el.unit(side - np.einsum("ij,ij->i", side, x)[:, None] * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * side
    for n in (50_000, 100_000_000):
        k, tables = el.parameters(n)
        assert tables < 1 << el.TABLE_BITS
        met = (el.table_keys(x, k, tables) == el.table_keys(y, k, tables)).any(axis=1).mean()
        assert met >= 0.995, (n, met)


def test_near_copies_of_texts_meet():
    """Recall of the bands alone, at the least similarity."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 2**63, 20).astype(np.uint64)])
        assert dm.similarity(np.sort(a), np.sort(b)) == 0.8
        keys = dm.band_keys(dm.signatures([a, b], dm.BANDS * dm.ROWS), dm.BANDS, dm.ROWS)
        met += (keys[0] == keys[1]).any()
    assert met >= 297


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(dm, "CELLS_A_UNIT", 64)
    monkeypatch.setattr(dm, "BLOCK", 8)
    rng = np.random.default_rng(6)
    long = [f"w{i}" for i in rng.integers(0, 10**6, 60_000)]
    own = [" ".join(long), " ".join(long[:-100]), " ".join(long[5000:]), " ".join(reversed(long)), "short text of few words", " ".join(long[:20_000])]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(own)], "doc_id long, text string, band_key string, root string")
    assert {r.doc_id: r.class_id for r in dm.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert dm.deduplicated(docs).count() == 4


def test_classes_without_ids(spark):
    docs = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (None, None), (3, "four five six")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.class_id or 0, r.kept) for r in dm.near_duplicates(docs).collect())) == [(0, 0, True)] * 3 + [(3, 3, True)]
    assert dm.deduplicated(docs).count() == 4
