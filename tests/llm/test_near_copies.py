"""The pipeline's near copies against all pairs of texts, with planted edited copies."""

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import near_text

WORDS = np.array([f"word{i}" for i in range(5000)])


def runs_of(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w)} if len(w) <= n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_similar(docs):
    sets, root = {d: runs_of(t) for d, t in docs}, {d: d for d, _ in docs}
    for a in sorted(sets):
        for b in sets:
            if b < a and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def edited(rng, words, edits):
    words = words.copy()
    words[rng.choice(len(words), edits, replace=False)] = rng.choice(WORDS, edits)
    return words


def planted():
    """40 texts of 60 to 300 words with copies of 1 to 6 changed words, then a chain and a family about one text."""
    rng, texts = np.random.default_rng(8), []
    for _ in range(40):
        base = rng.choice(WORDS, rng.integers(60, 300))
        texts += [base, *(edited(rng, base, k) for k in (1, 2, 4, 6))]
    base = rng.choice(WORDS, 200)
    for _ in range(12):
        texts.append(base)
        base = edited(rng, base, 2)
    base = rng.choice(WORDS, 200)
    texts += [edited(rng, base, rng.integers(1, 6)) for _ in range(60)]
    order = rng.permutation(len(texts)).tolist()
    return [(d, " ".join(texts[i])) for d, i in enumerate(order)] + [(900, ""), (901, None), (902, "Short text"), (903, "short  TEXT"), *((910 + k, f"two runs of words in{k}") for k in range(40)), *((960 + k, f"in{k} six little words make two") for k in range(40))]


@pytest.fixture(scope="module")
def docs():
    return planted()


def classes(root):
    found = {}
    for d, r in root.items():
        found.setdefault(r, set()).add(d)
    return found


@pytest.mark.parametrize("group", [near_text.GROUP, 8])
def test_similar_groups(spark, docs, group):
    got = {r.doc_id: r.component_id for r in near_text.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), group=group).collect()}
    want = {**brute_similar(docs), 901: 900}
    # nothing is linked below the bound, and next to nothing above it is missed
    assert set(got) == set(want) and all(len({want[d] for d in c}) == 1 and min(c) == r for r, c in classes(got).items())
    copies = [d for d, r in want.items() if d != r]
    assert len(copies) > 100 and sum(got[d] != d for d in copies) >= 0.98 * len(copies)


def test_recall_near_the_bound(spark):
    """Of pairs with a similarity of 0.8 to 0.85, nine in ten are found; of nearer pairs 98 in a hundred."""
    rng, rows, near = np.random.default_rng(5), [], {}
    for k in range(600):
        base = rng.choice(WORDS, 250)
        at = np.sort(rng.choice(50, rng.integers(1, 7), replace=False)) * 5  # edits that share no run
        other = base.copy()
        other[at] = rng.choice(WORDS, len(at))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = runs_of(rows[-2][1]), runs_of(rows[-1][1])
        near[2 * k + 1] = len(a & b) / len(a | b)
    got = {r.doc_id: r.component_id for r in near_text.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 1, 0.98)):
        own = [d for d, x in near.items() if low <= x < high]
        assert len(own) > 80 and sum(got[d] == d - 1 for d in own) >= least * len(own), (low, sum(got[d] == d - 1 for d in own), len(own))
    assert all(got[d] == d for d, x in near.items() if x < 0.8)


def test_meeting_in_chunks_misses_no_neighbour():
    """Rows of keys of all sizes, cut into batches anywhere: each row that has a near one under its key comes out, with the nearest smaller one."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 1, 16, 17, 40, 1, 3, 90, 2]
    key = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 63, (len(sizes), 1, near_text.WORDS), dtype=np.uint64)
    words = np.concatenate([np.where(rng.random((n, 1)) < 0.7, b, rng.integers(0, 1 << 63, (n, near_text.WORDS), dtype=np.uint64)) for n, b in zip(sizes, base)])
    words[:, 0] ^= np.uint64(1) << rng.integers(0, 60, len(key)).astype(np.uint64)
    s = rng.permutation(len(key))
    columns = [key, s, *words.view(np.int64).T, np.zeros(len(key), np.int32)]
    for size in (3, 11, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], ["key", "s", *near_text.COLUMNS, "flip"]) for i in range(0, len(key), size)]
        out = [tuple(r.values()) for b in near_text._meet(16, [])(iter(batches)) for r in b.to_pylist()]
        assert {k for k, *_ in out} <= set(key.tolist())
        for k, n in enumerate(sizes):
            own = np.flatnonzero(key == k)
            apart = np.bitwise_count(words[own][:, None] ^ words[own][None]).sum(axis=2)
            met = {s[own[i]] for i in range(n) if ((apart[i] <= near_text.FAR) & (np.arange(n) != i)).any()}
            found = {x for kk, x, *_ in out if kk == k}
            assert met <= found and (n > 16 and found == set(s[own]) or n <= 16 and found == met)
            if n <= 16:
                for _, x, v, d in (r for r in out if r[0] == k):
                    i = own.tolist().index(np.flatnonzero(s == x)[0])
                    smaller = [(apart[i, j], s[own[j]]) for j in range(n) if s[own[j]] < x and apart[i, j] <= near_text.FAR]
                    assert (v is None and not smaller) or (d, v) == min(smaller)


@pytest.mark.parametrize("t", [0, 2, 4])
def test_a_pair_meets_once(spark, t):
    """Two fingerprints within reach count under one value of a partition, whichever of them is smaller; beyond it under none."""
    rng, bits, rows, reach = np.random.default_rng(2), np.array([*range(3, 15), *range(120, 128)]), [], 2 * near_text.radius(t)
    for k in range(60):
        a = rng.integers(0, 1 << 63, near_text.WORDS, dtype=np.uint64)
        b = a ^ near_text.words_of(sum(1 << int(x) for x in rng.choice(bits, k % 6, replace=False)))
        rows += [(s, *map(int, w.view(np.int64))) for s, w in zip(rng.permutation([2 * k, 2 * k + 1]).tolist(), (a, b))]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("s", *near_text.COLUMNS)))
    probes = near_text.keyed(nodes, 0, sum(1 << int(b) for b in bits), t).repartition("key").sortWithinPartitions("key")
    found = [(r.s, r.v) for r in probes.mapInArrow(near_text._meet(1024, []), "key bigint, s bigint, v bigint, d int").where("v is not null").collect()]
    assert sorted(found) == [(2 * k + 1, 2 * k) for k in range(60) if k % 6 <= reach]


def test_edited_copies_go(spark, docs):
    more = docs + [docs[0], (None, docs[3][1]), (None, "only here, without an id"), (docs[0][0], "another text under one id")]
    frame = spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _d", "3 AS s")
    kept = corpus_pipeline.near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {d for d, r in brute_similar(docs).items() if d == r} - {901}
    found = {d for d, _ in rows} - {None}
    assert want <= found and len(found - want) <= 0.02 * len(docs)
    assert len(rows) == len(set(rows)) and (None, "only here, without an id") in rows and (docs[0][0], "another text under one id") in rows
