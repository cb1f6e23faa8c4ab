"""Operators on texts against plain brute force, and their defined edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, language_id, line_dedup, packing, queries, simhash, toxicity, url_filter

COPY = "the same line of text here\nanother line that is shared\nxx"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, COPY, "fr"), (4, COPY, None), (5, COPY.upper(), "en"), (6, "ÉTÉ \U0001f600 naïve\tword", "fr"),
    (7, LONG, "en"), (8, LONG + " x", "en"), (9, "123 456 !!", None), (10, "\n\n", "en"), (11, "\x0b the same line of text here \r\n  ", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


def edge(spark, rows=EDGE):
    """Extra columns whose names clash with what operators use inside."""
    extra = ["row", "pos", "line", "h1", "gone", "fp", "node", "key", "ids", "piece", "length", "score", "label", "short", "_rank"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in extra})


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def brute_lines(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, sf):
    for frame, docs in ((spark.read.parquet(f"{sf}/documents.parquet"), docs_of(spark, sf)), (edge(spark), [r[:2] for r in EDGE])):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(frame).collect()}
        assert got == brute_lines(docs)
    assert line_dedup.line_dedup(edge(spark, [])).count() == 0
    thrice = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(edge(spark), min_docs=5).collect()}
    assert not any(thrice.values())


def test_line_dedup_moves_a_text_once(spark):
    """The join that brings a document its lost lines has each text in ``row``, and not beside it again."""

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [below] * (plan.nodeName() == "Join") + [j for p in below for j in joins(p)]

    rows, _ = joins(line_dedup.line_dedup(edge(spark), keep_null_ids=True)._jdf.queryExecution().optimizedPlan())[0]
    assert sorted(rows.output().apply(i).name() for i in range(rows.output().size())) == ["doc_id", "row", "th"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_items(docs, items, n=10):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in wins:
                    found |= wins[x]
                    hit |= set(range(k, k + m))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, sf):
    docs, items = docs_of(spark, sf), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op7_decontamination(spark, sf).collect())) == brute_items(docs, items)
    assert any(r[-1] for r in brute_items(docs, items))


@pytest.mark.parametrize("most", [50_000, 2])
def test_decontamination_edges(spark, most):
    items = [(1, "same line of TEXT here another"), (2, None), (3, ""), (4, "word"), (5, " ".join(f"w{i}" for i in range(40, 60))), (5, "naïve word"), (6, "absent words")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = EDGE + [EDGE[2], (3, "word", "en"), (3, "word word", "en")]
    got = decontaminate.find_items(edge(spark, rows), frame, pass_windows=most)
    found = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), len(r.items), decontaminate.digest(r.items), bool(r.spans)) for r in got.collect()]
    assert sorted(found) == brute_items([r[:2] for r in rows], items)
    none = decontaminate.find_items(edge(spark), frame.limit(0)).collect()
    assert len(none) == len(EDGE) and not any(r.spans for r in none)
    assert decontaminate.find_items(edge(spark, []), frame).count() == 0


def test_decontaminate_judges_rows(spark):
    rows = [(1, "a clean text", "en"), (1, "the benchmark passage", "en"), (None, "the benchmark passage", None), (None, "no such thing", None), (2, None, None), (2, "", None), (2, "", None)]
    items = spark.createDataFrame([(1, "benchmark passage")], "item_id long, text string")
    docs = edge(spark, rows).withColumn("_gone", F.lit(1))
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "no such thing"), (1, "a clean text"), (2, ""), (2, ""), (2, "")]


def brute_near(docs, items, slack):
    """Spans by the rule of proximity, for items that are one window."""
    counts, out = Counter(w for _, t in docs for w in words(t)), {}
    for d, t in docs:
        w, hit = words(t), set()
        for _, item in items:
            own = words(item)
            k = min(range(len(own)), key=lambda i: (counts[own[i]], i))
            for at in (i for i, x in enumerate(w) if x == own[k]):
                near = [min((i for i, x in enumerate(w) if x == y), key=lambda i: (abs(i - at), i), default=None) for y in own]
                if all(i is not None and abs(i - at) <= slack for i in near):
                    hit |= set(range(min(near), max(near) + 1))
        out[d] = hit
    return out


@pytest.mark.parametrize("slack", [1, 3, 6])
def test_proximity(spark, slack):
    import random

    rng = random.Random(slack)
    docs = [(1, "x b"), (2, "a y y y b"), (3, "b a"), (4, "c c a"), (5, None)] + [(d, " ".join(rng.choices("abcdefyz", k=rng.randint(0, 12)))) for d in range(10, 200)]
    items = [(1, "a b"), (2, "c d c"), (3, "e f a b"), (4, "z q")]
    got = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), slack=slack)
    assert {r.doc_id: {i for a, b in r.spans for i in range(a, b)} for r in got.collect()} == brute_near(docs, items, slack)


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def reference_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, docs, most=2048):
    ids, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        ids[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in docs:
        full = reference_ids(t)
        pieces = [ids[d][k] for k in range(len(ids[d]))]
        assert [p.start for p in pieces] == list(range(0, len(full), most))
        for p in pieces:
            part = full[p.start : p.start + p.length]
            assert len(part) == p.length == min(most, len(full) - p.start)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(bins), -(-sum(r.length for r in rows) // most)


def test_packing(spark, sf):
    rows = queries.op8_packing(spark, sf).collect()
    used, least = check_packing(rows, docs_of(spark, sf))
    assert used <= least * 1.01 + 2
    edges = packing.pack_documents(edge(spark), queries.tokenizer_path())
    check_packing(edges.collect(), [r[:2] for r in EDGE])
    assert packing.pack_documents(edge(spark, []), queries.tokenizer_path()).count() == 0


def test_packing_encodes_a_word_once_whatever_marks_follow(monkeypatch):
    import tokenizers

    text, seen = "Thousand été thousand, été. thousand!! THOUSAND.$$$ été*** thousand) été;", []
    want = reference_ids(text)[:-1]

    class Recorded:
        """A tokenizer that notes the words it is given."""

        def __init__(self, own):
            self.__dict__["own"] = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        def encode_batch_fast(self, texts, **options):
            seen.extend(re.findall("[a-zà-ÿ]+", " ".join(texts).lower()))
            return self.own.encode_batch_fast(texts, **options)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda path: Recorded(real.from_file(path)))}))
    encoder = packing.ChunkEncoder(queries.tokenizer_path())
    for _ in range(2):
        ids, n = encoder.encode([text, ""])
        assert ids.tolist() == want and n.tolist() == [len(ids), 0]
    assert Counter(seen) == {"thousand": 1, "été": 1}


def test_packing_ids_of_odd_texts():
    import random

    r = random.Random(8)
    parts = [*"abzABZ 019'.,;:!?$&*#-_<>|/\\\"()[]{}~`^@=+\n\t\x00\x7f éÉßÿþÀ÷×ªºµ", "'s", "'ll", "<|endoftext|>", "<|", "|>", "\u0301", "\u0338", "\u0130", "\u01c5", "中", "Дом", "ς", "Σ", "\u00a0", "\u200d", "  ", "word", "don't", "a.b", "$$$"]
    latin = [p for p in parts if max(p) < "\u0100" and "|" not in p]
    texts = ["".join(r.choice(kind) for _ in range(r.randrange(30))) for kind in (parts, latin) for _ in range(3000)]
    encoder = packing.ChunkEncoder(queries.tokenizer_path())
    ids, n = encoder.encode(texts)
    assert encoder.encode([])[1].tolist() == []
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == reference_ids(text)[:-1], text
        at += k


def test_packing_salted_ranks(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 700).otherwise(100 + F.col("id") % 900).alias("length"))
    rows = packing.pack(pieces, 1000, salts=7).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 5000 and all(sorted(b)[-1][0] + sorted(b)[-1][1] == sum(x[1] for x in b) <= 1000 for b in bins.values())


def test_fullest_combination():
    from itertools import combinations

    for lengths in ([7, 5, 4, 3], [9, 9, 2, 2, 1], [10], [6, 6, 5, 5, 4]):
        best = max(sum(c) for k in range(1, len(lengths) + 1) for c in combinations(lengths, k) if max(lengths) in c and sum(c) <= 13)
        assert sum(packing.fullest(Counter(lengths), 13)) == best


def brute_simhash(docs):
    fps = []
    for d, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append((d, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))))
    return fps


def brute_components(fps, tau=2):
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(parent)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= tau:
                parent[find(a)] = find(b)
    least = {}
    for d, f in fps:
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: (f"{f:016x}", least[find(f)]) for d, f in fps}


def test_simhash(spark, sf):
    docs = docs_of(spark, sf)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf).collect()}
    assert got == brute_components(brute_simhash(docs))
    edges = simhash.simhash_groups(edge(spark)).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    assert {r.doc_id: (r.f, r.component_id) for r in edges.collect()} == brute_components(brute_simhash([r[:2] for r in EDGE]))
    assert simhash.simhash_groups(edge(spark, [])).count() == 0


def test_simhash_hot_family(spark):
    """A family whose members differ in a few bits is parted again, and no link is lost."""
    import random

    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    for group in (128, 1024):
        from quantloom.llm.components import components

        roots = {r.node: r.root for r in components(simhash.near_links(frame, 2, group)).collect()}
        classes = defaultdict(set)
        for i, f in enumerate(fps):
            s = f - (1 << 64) if f >> 63 else f
            classes[roots.get(s, s)].add(i)
        assert {frozenset(c) for c in classes.values()} == {frozenset(i for i, x in want.items() if x[1] == k) for k in {x[1] for x in want.values()}}


def test_free_bits_are_longs(spark):
    """Thresholds above zero leave all bits free, a number that a literal alone would make an int; parting again must read it whole."""
    fps = spark.createDataFrame([(x * 7919,) for x in range(50)], "fp long")
    rows = simhash.probes(fps, [((1 << 32) - 1, 2), ((1 << 40) - (1 << 32), 1)])
    assert dict(rows.dtypes)["free"] == "bigint" and {r.free for r in rows.select("free").distinct().collect()} == {-1}
    again = rows.mapInArrow(simhash._part_again(2), "key bigint, free bigint, fp bigint")
    assert again.count() == 3 * rows.count() and {r.fp for r in again.collect()} == {r.fp for r in fps.collect()}


def test_thresholds_follow_the_principle():
    import numpy as np

    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    for n in (1000, 10**7):
        for tau in (1, 2, 3):
            parts = simhash.plan(n, both / 1000 * n, tau)
            assert parts and all(t >= 0 for _, t in parts)
    assert simhash.allocate([[0, 1, 9], [0, 50, 90], [0, 2, 4]], 0)[1] in ([0, -1, 1], [1, -1, 0])


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    prototypes = language_id.train(edge(spark), F.col("lang"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(edge(spark), prototypes).collect()}
    assert {d for d, x in got.items() if x == "und"} == {1, 2, 9, 10} and got[6] == "fr"
    assert language_id.identify(edge(spark, []), prototypes).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge(spark), {}).collect()} == {"und"}


def test_profiles_bundle_ngrams():
    import numpy as np

    text = "Ab c, ab"
    letters = [" ", "a", "b", " ", "c", " ", "a", "b", " "]
    want = np.zeros(64)
    for i in range(len(letters) - 2):
        v = np.ones(64)
        for k in range(3):
            v = v * np.roll(language_id.letter_vector(ord(letters[i + k]), 64), 2 - k)
        want += v
    assert (language_id.profiles([None, text, "1"], 64)[1] == want).all()


def brute_languages(docs, dim=language_id.DIM):
    """(prediction, score) of each (id, text, lang) by plain sums of n-gram vectors and cosines."""
    import numpy as np

    @cache
    def gram(g):
        v = np.ones(dim)
        for k, c in enumerate(g):
            v = v * np.roll(language_id.letter_vector(ord(c), dim), len(g) - 1 - k)
        return v

    def bundle(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        low = " " + " ".join(low.split(" ")).strip() + " "
        low = re.sub(" +", " ", low)
        grams = Counter(low[i : i + 3] for i in range(len(low) - 2)) if low.strip() else {}
        return sum((n * gram(g) for g, n in grams.items()), np.zeros(dim))

    vectors = {d: bundle(t) for d, t, _ in docs}
    prototypes = {}
    for d, t, lang in docs:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            prototypes[lang] = prototypes.get(lang, 0) + vectors[d]
    out = {}
    for d, v in vectors.items():
        cos = {k: v @ p / np.sqrt((v @ v) * (p @ p)) for k, p in sorted(prototypes.items())} if v.any() else {}
        best = max(cos, key=cos.get) if cos else "und"
        out[d] = (best, max(0.0, cos.get(best, 0.0)))
    return out


def test_language_id_against_plain_sums(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_languages(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-5 for d in want)


def test_toxicity_against_plain_loops(spark, tmp_path):
    """Counts, ratios, evidence and scores recomputed n-gram by n-gram; the fitted weights stand where the loss is flat."""
    import math

    import numpy as np

    rows = [(d, " ".join(["vile" if d % 3 == 0 else "kind", "words,  and", f"w{d % 7}", "Ünd", "злой" if d % 3 == 0 else "добрый", "恶毒的字" if d % 3 == 0 else "好的文字"]), int(d % 3 == 0)) for d in range(60)] + [(90, "", 0), (91, "vile", 7), (92, "kind", -1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    width, sizes = 12, (4, 6)

    def buckets(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        raw = [ord(c) for c in re.sub(r"[^a-z\x80-\U0010ffff]+", " ", f" {low} ")]
        found = set()
        for size in sizes:
            for i in range(len(raw) - size + 1):
                h = 0
                for b in raw[i : i + size]:
                    h = (h * 0x01000193 + b + 1) % 2**32
                found.add(((h ^ (size - 1)) * 0x9E3779B1 % 2**32) >> (32 - width))
        return found

    own = [(buckets(t), y) for _, t, y in rows if y in (0, 1)]
    seen = [Counter(b for found, y in own if y == k for b in found) for k in (0, 1)]
    sample = toxicity.training_sample(docs, labels)
    clean, toxic = toxicity.counts(sample, sizes, width)
    assert all(clean[b] == seen[0][b] and toxic[b] == seen[1][b] for b in range(1 << width))
    total = [sum(seen[k].values()) + (1 << width) for k in (0, 1)]
    ratio = toxicity.log_count_ratio(clean, toxic)
    assert all(abs(ratio[b] - math.log((seen[1][b] + 1) / total[1] * total[0] / (seen[0][b] + 1))) < 1e-12 for b in range(1 << width))
    model = toxicity.fit(docs, labels, sizes=sizes, width=width, rounds=4000, decay=1e-3)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    plain = {d: 1 / (1 + math.exp(-model.bias - sum(weight.get(b, 0) for b in buckets(t)))) for d, t, _ in rows}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[d] - plain[d]) < 1e-5 for d in plain) and got[0] > 0.7 > 0.3 > got[1]
    n = [sum(y == k for _, y in own) for k in (0, 1)]
    error = [(plain[d] - y) / (2 * n[y]) for d, _, y in rows if y in (0, 1)]
    for b, w in weight.items():
        if ratio[b]:
            slope = sum(e for e, (found, _) in zip(error, own) if b in found) * ratio[b] + 1e-3 * w / ratio[b]
            assert abs(slope) < 2e-3


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, sf).collect()]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    wrong = [r for r in held if r.predicted != labels[r.doc_id]]
    assert len(wrong) / len(held) < 0.02
    assert sum(r.predicted and not labels[r.doc_id] for r in held) / len(held) < 0.005
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int")
    assert all(r.score > 0.9 for r in toxicity.score(edge(spark), toxicity.fit(edge(spark).select("doc_id", "text"), one)).collect())
    none = toxicity.fit(edge(spark).select("doc_id", "text"), one.limit(0))
    assert toxicity.score(edge(spark, []), none).count() == 0


def test_url_filter(spark):
    urls = [None, "no scheme", "http://", "http://COM/", "https://a.example.com/en/x?q=1", "https://www.example.com/en/", "https://www.example.com/en", "ftp://x.net/es/#f", "http://a.com", "http://a.com?x=/", "http://xcom/", "http://a.example.com:80/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("short", F.lit(2))
    rules = spark.createDataFrame(queries.URL_RULES + [("a.com", None, "block"), ("net", "/e", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[3] == ("com", "/", "com/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6] == ("www.example.com", "/en", "com/", "allow") and got[7] == ("x.net", "/es/", "net/es/", "block")
    assert got[8] == ("a.com", "", "a.com", "block") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_with_a_very_long_path(spark):
    long = "http://a.example.com/en/" + "x/" * 100_000
    pages = spark.createDataFrame([(k, long) for k in range(3)] + [(9, "http://a.example.com/en/" + "y" * 9000), (10, "http://" + "b." * 300 + "net/fr/")], "page_id long, url string")
    deep = "/en/" + "x/" * 30
    rules = spark.createDataFrame(queries.URL_RULES + [("example.com", deep, "allow"), ("com", "/en/y", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {0: ("example.com" + deep, "allow"), 1: ("example.com" + deep, "allow"), 2: ("example.com" + deep, "allow"), 9: ("example.com/en/", "block"), 10: ("net/fr/", "block")}


def test_url_with_very_many_labels(spark):
    """A host is cut where rules have labels, not at each of its own."""
    host = "a." * 100_000
    pages = spark.createDataFrame([(1, f"http://{host}example.com/en/"), (2, f"http://{host}net/fr/"), (3, f"http://{host}"), (4, "http://..com/"), (5, "http://www.example.com/en/x")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES + [("b.c.d.e.f.g.net", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block", 200_011), 2: ("net/fr/", "block", 200_003), 3: (None, "allow", 200_000), 4: ("com/", "allow", 5), 5: ("www.example.com/en/", "allow", 15)}


def test_grams_are_of_characters():
    import numpy as np

    one = lambda t: set(toxicity.gram_codes([t], (4,), 20)[0].tolist())
    assert len(one("汉字词")) == 2 and len(one("слово")) == 4  # with a blank on either side
    assert one("a b") == one("A,  b") == one(" a\n\tb ") and one("ab") != one("a b")
    raw, ends = toxicity.letters(["", " x", "Ab,. c!", ""])
    assert "".join(map(chr, raw)) == "  x  ab c  " or np.diff(np.append(0, ends)).tolist() == [1, 3, 6, 1]
    codes, owners = toxicity.gram_codes(["abcd", "", "efgh"], (4,), 20)
    assert set(owners.tolist()) == {0, 2} and len(codes) == 6  # none runs on into the next text


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    """With room for few hot keys and for many, a join gives the same rows."""
    from quantloom.llm import common

    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("k"))
    small = common.durable(big.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.length("k")).where("k <> '7'"), "small")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small.drop("n"), "k", how).select("id", "k", "x").collect()))
        for keys in (0, 10, 1000):
            monkeypatch.setattr(common, "HOT_KEYS", keys)
            got = common.keyed_join(big, small, ["k"], "n", how)
            assert sorted(map(str, got.select("id", "k", "x").collect())) == want
