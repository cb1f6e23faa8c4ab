"""Spelling variants: words one edit apart, found by letter-parity bitmasks cut into bands.

A word's mask holds, for each letter, whether it stands there an odd number of times. A replaced letter flips two bits or
none, so one of three bands stays equal; an inserted or deleted letter flips one bit, so two bands do. The edit also leaves
the word's first or last half as it was. Words meet under equal bands, lengths that fit and one equal half, and are then compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, durable, framed

#: Maximal runs of these are words before lower-casing.
RUNS = "[A-Za-zÀ-ÿ]+"
BANDS = 3
#: Bits of a band; three of them fill a signed long.
WIDTH = 21
#: Rows on each side of the band join for each of its partitions, about.
ROWS_A_TASK = 200_000


def _lowered(run: Column) -> Column:
    """A-Z lower-cased; runs that are all lower case already, ASCII or not, take a fast path."""
    return F.when((F.octet_length(run) == F.char_length(run)) | (F.lower(run) == run), F.lower(run)).otherwise(ascii_lower(run))


def misspelt_words(docs: DataFrame, min_chars: int = 6, drop_every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` for every run of letters in ``docs``, A-Z lower-cased, of which about one in ``drop_every`` has lost a code point.

    With h the crc32 of ``<doc_id>:<run>``, a run loses its code point h % length where ``drop_every`` divides h; 0 leaves all whole.
    Words of fewer than ``min_chars`` code points are left out. Null texts have no words; neither have rows without an id, which has to be hashed.
    """
    rows = framed(docs, id_col, text_col)
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run")).where(F.char_length("run") >= min_chars)
    runs = runs.select("doc_id", _lowered(F.col("run")).alias("run"))
    if not drop_every:
        return runs.select(F.col("run").alias("word"))
    hashed = runs.select("run", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")).alias("h"))
    hit, at = F.col("h") % drop_every == 0, (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.where((F.char_length("run") > min_chars) | ~hit).select(F.when(hit, cut).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, min_count: int = 5) -> DataFrame:
    """``word, n`` of the distinct words (column ``word``) that are frequent enough."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


@dataclass(frozen=True)
class Bands:
    """Which bit a letter has, and the bits that each key compares.

    ``letters`` have the bits ``bits``; any other letter shares a bit by its hash, which costs candidates but no link.
    """

    letters: tuple[str, ...]
    bits: tuple[int, ...]
    same: tuple[int, ...]  #: for words of one length: one band each
    longer: tuple[int, ...]  #: for words whose lengths differ by one: two bands each

    def mask(self, word: Column) -> Column:
        held = F.create_map(*[F.lit(x) for pair in zip(self.letters, self.bits, strict=True) for x in pair]) if self.letters else F.create_map().cast("map<string,int>")
        bits = F.transform(_letters(word), lambda c: F.coalesce(F.try_element_at(held, c), F.pmod(F.hash(c), F.lit(BANDS * WIDTH))))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda m, b: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def _dealt(weights: dict[int, float], parts: int, most: int = 1 << 30) -> list[list[int]]:
    """Keys of ``weights`` in ``parts`` lists of about one weight and at most ``most`` keys, heaviest first."""
    out: list[list[int]] = [[] for _ in range(parts)]
    held = [0.0] * parts
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        to = min((p for p in range(parts) if len(out[p]) < most), key=lambda p: (held[p], p))
        out[to].append(key)
        held[to] += weights[key]
    return out


def bands(words: DataFrame) -> Bands:
    """Bands that tell words apart about equally well: letters are dealt by the entropy of their parity.

    The driver gets the 63 letters that stand in most words, with two counts each.
    """
    letters = words.select("word", F.explode(_letters(F.col("word"))).alias("letter")).groupBy("word", "letter").agg((F.count("*") % 2).alias("odd"))
    top = letters.groupBy("letter").agg(F.count("*").alias("n"), F.sum("odd").alias("odd")).orderBy(F.desc("n"), "letter").limit(BANDS * WIDTH).collect()
    total = max(1, words.count())
    entropy = {}
    for i, r in enumerate(top):
        p = min(max(r.odd / total, 1e-9), 1 - 1e-9)
        entropy[i] = -(p * math.log2(p) + (1 - p) * math.log2(1 - p))
    owned = _dealt(entropy, BANDS, WIDTH)
    bit = {i: WIDTH * band + place for band, own in enumerate(owned) for place, i in enumerate(own)}
    same = [((1 << WIDTH) - 1) << (WIDTH * band) for band in range(BANDS)]
    return Bands(tuple(r.letter for r in top), tuple(bit[i] for i in range(len(top))), tuple(same), tuple(sum(same) - m for m in same))


def near_words(words: DataFrame, by: Bands) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of different words (``word, n``) that one inserted, deleted or replaced code point parts, once.

    What meets is told apart by the bits of both masks and at last by edit distance. Only pairs that pass are made distinct, for
    several keys may join one.
    """
    masks = durable(words.select("word", "n", by.mask(F.col("word")).alias("mask")), "masks")
    size = F.char_length("word")

    def keyed(shorter: Column, longer: Column) -> DataFrame:
        """A row for each key: ``shorter`` is how long a word has to be, that of words of one length and that of a longer word's partner."""
        keys = []
        for kind, found, length in (("same", by.same, shorter), ("longer", by.longer, longer)):
            half = F.floor(length / 2).cast("int")
            head, tail = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), size - length + half + 1, size)
            for q, m in enumerate(found):
                for part, text in (("head", head), ("tail", tail)):
                    keys.append(F.xxhash64(F.lit(f"{kind} {q} {part}"), F.col("mask").bitwiseAND(F.lit(m)), length, text))
        return masks.select("word", "n", "mask", F.explode(F.array(*keys)).alias("key"))

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(masks.count() * 4 * BANDS / ROWS_A_TASK))
    left = keyed(size, size).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = keyed(size, size - 1).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    met = left.repartition(parts, "key").join(right.repartition(parts, "key"), "key")
    once = (F.char_length("a") < F.char_length("b")) | (F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b"))
    met = met.where((F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2) & once)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: where forms lead at last. Every round halves what is left of the ways; forms must not run in circles."""
    state = durable(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = state.join(step, "root", "left")
        after = durable(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        discard(state)
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        state = after


def spelling_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Group the words of ``counts`` (``word, n``, each word once) by their likeliest spelling.

    Returns ``word, form, root, n, n_near, form_n``: ``n_near`` near words (one code point inserted, deleted or replaced), ``form`` the
    most frequent of them (ties: smallest in code-point order) if it is ``ratio`` times as frequent as the word, else null, ``form_n`` its
    count, and ``root`` where forms lead from word to word, or the word itself.

    * an empty table gives an empty result; a word without near words has ``n_near`` 0 and is its own root
    * ``ratio`` must be over 1, so that counts grow from form to form and none leads back
    * all words are compared, none is capped; a band value that many words share is one task's stream, not its memory
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = durable(counts.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = durable(near_words(words, bands(words)), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    found = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "variants")
    discard(words, pairs)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
