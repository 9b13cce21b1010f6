"""Operators on whole tables, and the pipeline, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallystone.llm import bpe, dart_minhash, divergence, histogram_shards, language_id, mixing, registry
from tallystone.llm.common import WORD, components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size string, key string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y", 3) for i, t, s in rows], SCHEMA)


def awkward():
    rows = [(i, " ".join(["w%d" % (i % 7)] * (i * 37 % 50)), f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, "one two three", "big") for i in range(60)] + [(200, None, "s0"), (201, "", None), (202, "a b", None), (None, "x y z", "s1"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (203, "q " * 4000, "big"), (204, None, "empty")]
    return rows


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        share = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in left)
        above = {s for s in left if share * w[s] > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in full else share * w[s] for s in names}
        full |= above


def key_of(i, text):
    return int(hashlib.md5(f"mix|{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize(("range_rows", "most"), [(4096, 8 << 20), (3, 0)])
def test_mixing_matches_brute_force(spark, monkeypatch, range_rows, most):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
    rows = awkward()
    sized = [(i, len(WORD.findall(t or "")), s, key_of(i, t)) for i, t, s in rows]
    sizes = Counter()
    for _, n, s, _ in sized:
        sizes[s] += n
    target = brute_targets(sizes)
    want = []
    for s in sizes:
        own = sorted((r for r in sized if r[2] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1]))
        words = int(target[s])
        passes, rest = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        for i, n, _, _ in own:
            cut = max(0, min(n, rest))
            rest -= n
            want.append((i, n, sizes[s], target[s], passes * n + cut))
    got = mixing.mix(table(spark, rows)).collect()
    plain = lambda x: sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in x)
    assert plain(map(tuple, got)) == plain(want)
    for s, n in sizes.items():
        taken = sum(w[4] for w in want if w[2:4] == (n, target[s]))
        assert n == 0 or taken >= int(target[s]) - 1
    assert all(w[4] <= 3 * w[1] for w in want)
    assert mixing.mix(table(spark, rows[:0])).count() == 0


def test_mixed_documents_keep_whole_texts(spark):
    rows = awkward()
    docs = table(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.collect())
    there = Counter((i, t) for i, t, _ in rows)
    assert set(times) <= set(there)
    for r in mixing.mix(docs).where("doc_id is not null and doc_id <> 5").collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert abs(times[(r.doc_id, text)] - (r.taken / r.size if r.size else 0)) <= 0.5


def brute_shards(rows, shards, tolerance):
    sized = []
    for i, t, _ in rows:
        part = int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16)
        own = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) >> 1
        sized.append((part << 31 | own, len((t or "").encode()) + 16, i, t))
    total = sum(r[1] for r in sized)
    by_key, by_part = Counter(), Counter()
    for key, size, *_ in sized:
        by_key[key] += size
        by_part[key >> 31] += size

    def starts(sums):
        at, out = 0, {}
        for k in sorted(sums):
            out[k] = at
            at += sums[k]
        return out

    key_at, part_at = starts(by_key), starts(by_part)
    out = []
    for key, size, i, t in sized:
        p = key >> 31
        begin, unit = (part_at[p], by_part[p]) if by_part[p] * shards <= tolerance * total else (key_at[key], by_key[key])
        out.append((i, size, zlib.crc32((t or "").encode()), min(shards - 1, (2 * begin + unit) * shards // (2 * total))))
    return out


@pytest.mark.parametrize(("shards", "tolerance"), [(40, 0.01), (7, 0.3), (1, 0.01), (500, 0.5)])
def test_shards_match_brute_force(spark, shards, tolerance):
    rows = awkward() + [(1000 + i, f"text {i} {'é' * (i % 9)}", "s") for i in range(300)] + [(2000 + i, "copy " * 30, "hot") for i in range(200)]
    got = histogram_shards.shard(table(spark, rows), shards, tolerance).collect()
    plain = lambda x: sorted((-1 if r[0] is None else r[0], *r[1:]) for r in x)
    assert plain((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == plain(brute_shards(rows, shards, tolerance))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_very_long_texts_are_sized_whole(spark):
    rows = [(i, f"short {i}", "s") for i in range(60)] + [(100, "lang " * 400_000, "s"), (101, None, None), (102, "", "t")]
    got = {r.doc_id: r for r in histogram_shards.shard(table(spark, rows)).collect()}
    assert got[100].size == 2_000_016 and [i for i, r in got.items() if r.shard == got[100].shard and i != 100 and r.size > 30] == []
    assert {(r.doc_id, r.shard) for r in got.values()} == {(i, k) for i, _, _, k in brute_shards(rows, 40, 0.01)}
    mixed = {r.doc_id: r for r in mixing.mix(table(spark, rows)).collect()}
    assert mixed[100].size == 400_000 and sum(r.taken for r in mixed.values() if r.target == mixed[100].target) in (int(mixed[100].target), int(mixed[100].target) - 1)


def test_no_shards_of_no_rows(spark):
    assert histogram_shards.shard(table(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (25, 2))]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_pipeline_matches_brute_force(spark):
    docs_schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    model = language_id.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    left = [d for d, ok in zip(docs, model.sure([d.text for d in docs], 0.5), strict=True) if ok]
    assert len(left) > 100 and all(d.text and any(map(str.isalpha, d.text)) for d in left)
    good = {r.doc_id: r.kept for r in divergence.judge(spark.createDataFrame(left, docs_schema)).collect()}
    left = [d for d in left if good[d.doc_id]]
    cells = [np.sort(dart_minhash.unit_cells(dart_minhash.shingles(d.text))) for d in left]
    up = list(range(len(left)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(left)):
        for j in range(i):
            if dart_minhash.similarity(cells[i], cells[j]) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    lowest = {}
    for i, d in enumerate(left):
        lowest[top(i)] = min(lowest.get(top(i), d.doc_id), d.doc_id)
    left = [d for i, d in enumerate(left) if lowest[top(i)] == d.doc_id]
    sizes = Counter()
    for d in left:
        sizes[d.source] += len(WORD.findall(d.text))
    target, want, codec = brute_targets(sizes), Counter(), bpe.codec(bpe.vocabulary_path())
    for s in sizes:
        passes, rest = divmod(int(target[s]), sizes[s])
        for d in sorted((d for d in left if d.source == s), key=lambda d: (key_of(d.doc_id, d.text), d.doc_id)):
            own = len(WORD.findall(d.text))
            times = passes + (2 * max(0, min(own, rest)) >= own)
            rest -= own
            ids = codec.encode(d.text)
            if times:
                want[(d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())] += times
    got = Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert got == want and len(docs) > len(left) > 50


def test_stages_return_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "byte_bpe"]


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
