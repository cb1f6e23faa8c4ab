"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from quantloom.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs, min_count=5):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= min_count}


def brute_variants(n, ratio=5):
    """Near are words that differ in one place, or of which one is the other without one code point."""
    near, places = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            places[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for ws in places.values():
        if len(ws) > 1:
            for w in ws:
                near[w] |= ws - {w}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x.encode()))
        if n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, folder):
    at = f"/root/testdata/{folder}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(docs))
    assert any(w[0] for w in want.values())
    assert got(queries.op11_spelling_variants(spark, at)) == want


def test_every_kind_of_edit_and_chains(spark):
    n = {
        "nation": 5000, "natino": 9, "nationn": 700, "anation": 6, "natin": 800, "nasion": 4, "ñation": 3, "nasionn": 1, "nation\U0001f600": 2,
        "中文字词": 50, "中文字": 7, "aaaaaa": 10, "aaaaaaa": 2, "aaaaab": 10, "a": 100, "b": 3, "": 1, "ab": 20, "tie": 5, "tiea": 25, "tieb": 25,
    }
    counts = spark.createDataFrame([(w, k, "clash") for w, k in n.items()] + [(None, 9, "clash")], "word string, n int, key string")
    assert got(spelling.spelling_variants(counts)) == brute_variants(n)
    assert got(spelling.spelling_variants(counts, ratio=2)) == brute_variants(n, 2)
    assert spelling.spelling_variants(counts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(counts, ratio=1)


def test_one_letter_misspelt_thousandfold(spark):
    """All near words of one word, which share most keys: no pair is lost."""
    base = "kraftwerk"
    n = {base: 10_000} | {base[:i] + c + base[i + k :]: 1 + ord(c) % 7 for i in range(9) for c in "abcdefghijklmnopqrstuvwxyzéü÷" for k in (0, 1) if base[:i] + c + base[i + k :] != base}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.spelling_variants(counts)) == brute_variants(n)


def test_runs(spark):
    rows = [(1, None), (2, ""), (3, "ÀÉ×÷ÿĀ Nationalé-NATIONALÉ İstanbul1stanbul"), (None, "without id"), (5, "x " * 50_000 + "lastword")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, run string, h string")
    words = lambda **kw: Counter(r.word for r in spelling.misspelt_words(docs, **kw).collect())
    assert words(drop_every=0, min_chars=3) == Counter(["ÀÉ×÷ÿ", "nationalé", "nationalÉ", "stanbul", "stanbul", "lastword"])
    every = words(drop_every=1, min_chars=1)
    assert sum(every.values()) == 6 and all(len(w) in (4, 6, 7, 8) for w in every)  # of 50,000 one-letter words nothing is left
    assert words(drop_every=1, min_chars=7) == Counter({w: k for w, k in every.items() if len(w) >= 7})
