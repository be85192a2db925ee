from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import minhash as M


def shingle_set(text, size=M.SHINGLE):
    words = [w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard_pairs(texts, least):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    shared = defaultdict(int)
    for ids in post.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] += 1
    out = {}
    for (a, b), n in shared.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= least:
            out[a, b] = j
    return out


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_recall_and_precision_against_brute_force(documents, texts):
    got = {r.doc_id: r.group_id for r in M.groups(documents).collect()}
    true = jaccard_pairs(texts, M.THRESHOLD)
    assert len(true) > 20
    found = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in true)
    assert found >= 0.9 * len(true)
    likely = roots(texts, jaccard_pairs(texts, M.THRESHOLD - 0.15))
    assert all(likely[i] == likely[g] for i, g in got.items())


def test_agreeing_fields_and_corrected_similarity():
    rng = np.random.default_rng(0)
    low = rng.integers(0, 2**64 - 1, (40, 128), np.uint64)
    low[20:, :64] = low[:20, :64]
    for bits in (1, 2, 4, 8):
        packed = M.pack(low, bits)
        assert packed.shape == (40, 128 * bits // 8)
        field = (low >> np.uint64(32)) & np.uint64((1 << bits) - 1)
        for i in (0, 20, 39):
            assert (M.agreeing(packed[i], packed, bits) == (field == field[i]).sum(1)).all()
    packed = M.pack(low, 8)
    assert M.similarity(M.agreeing(packed[0], packed[20], 8), 128, 8) == pytest.approx(0.5, abs=0.03)


def test_bucket_links_have_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (6, 64), np.uint8)
    sig = base[rng.integers(0, 6, 300)].copy()
    for row in sig:
        at = rng.integers(0, 64, rng.integers(0, 60))
        row[at] = rng.integers(0, 256, len(at), np.uint8)
    ids = rng.permutation(300)
    for least in (40, 60, 70, 90):
        every = [(int(ids[a]), int(ids[b])) for a, b in itertools.combinations(range(300), 2) if M.agreeing(sig[a], sig[b], 4) >= least]
        links = M.bucket_links(ids, sig, 4, least)
        assert all(q >= least and a < b for a, b, q in links)
        assert roots(range(300), [x[:2] for x in links]) == roots(range(300), every)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    got = {r.id: r.root for r in M.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert all(got.get(i, i) == r for i, r in want.items())


def test_thousands_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(words, n))
    one, two = text(200), text(150)
    near = lambda t: " ".join(w if rng.random() > 0.02 else "changed" for w in t.split())
    rows = [(i, one) for i in range(2000)] + [(5000 + i, near(two)) for i in range(150)] + [(9000 + i, text(100)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = M.groups(df).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.group_id].add(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    assert groups[0] == set(range(2000)) and groups[5000] == set(range(5000, 5150)) and len(groups) == 2
    kept = {r.doc_id for r in M.keep_one(df).collect()}
    assert kept == {0, 5000} | set(range(9000, 9050))


def test_messy_and_empty(messy, empty):
    got = sorted(tuple(r) for r in M.groups(messy).select("doc_id", "group_id", "keep").collect())
    assert got == [(1, 1, True), (5, 1, False), (6, 1, False)]
    kept = M.keep_one(messy)
    assert kept.columns == messy.columns
    gone = {i for i, _, keep in got if not keep}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in messy.collect() if r.doc_id not in gone)
    assert M.groups(empty).count() == 0 and M.keep_one(empty).count() == 0


def test_large_buckets_are_linked_block_by_block(spark):
    """Documents that share boilerplate fall into one bucket; in blocks the groups are those of whole buckets."""
    rng = np.random.default_rng(5)
    boiler = " ".join(f"b{i}" for i in range(40))
    rows, own = [], rng.integers(0, 10**9, 30)
    for i in range(400):
        own = rng.integers(0, 10**9, 30) if i % 5 else own  # every fifth repeats most of its neighbour's words
        rows.append((i, boiler + " " + " ".join(f"w{x}" for x in own[: 30 - i % 3])))
    df = spark.createDataFrame(rows[1:], "doc_id long, text string").repartition(3)
    whole, blocks = ({(r.doc_id, r.group_id) for r in M.groups(df, block=b).collect()} for b in (10**6, 16))
    assert whole == blocks and whole


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        M.groups(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
