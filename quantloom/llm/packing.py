"""Packing documents into sequences by minimum bin slack.

The lengths of all pieces are counted first. Bins are then designed on those counts alone: each design takes the
longest length left and, with a bitset of reachable sums, the fullest combination of other lengths beside it, and
is used as often as the counts allow. At last every piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, durable, framed, ragged, tidy

#: Distinct words and other chunks of text whose ids a worker keeps at hand; beyond, it starts afresh.
CACHE = 800_000
#: Marks that may follow a word within a chunk.
MARKS = frozenset(",.;:!?")
#: Lower-case letters of Latin-1, and marks that may follow them; an apostrophe may begin a word's ending, so it is none of these.
LETTERS, AFTER = "[a-zß-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]"


def folded(text: str) -> str:
    """Lower case, as the vocabulary has it anyway, where no letter can meet a combining mark: then fewer chunks differ."""
    if "<|" in text:  # may be a special token's name, which minds case
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class ChunkEncoder:
    """Ids of whole texts from ids of their chunks between blanks.

    The vocabulary's splitter never joins what white space parts, so a text's ids are its chunks' ids in order.
    Only chunks not seen before reach the tokenizer. Nor does it join ``LETTERS`` and the marks ``AFTER`` them, so a
    word is encoded once whatever marks follow it, and without the normalizer, which leaves such words as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for words that are normalized and parted already
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, chunks: pa.Array, flat: np.ndarray, n: np.ndarray) -> None:
        """Remember new ``chunks``: their ids one after another, and how many each has."""
        self.known = pa.concat_arrays([self.known, chunks])
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(n) - n)
        self.lengths, self.ids = np.append(self.lengths, n), np.append(self.ids, flat)

    def _in_one_call(self, tokenizer, text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the chunks of ``text``, which have so many ``words`` each, and how many ids each has; None if some letters became others."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != words.sum() or (len(ends) and ends[-1] != len(ids)):
            return None
        return ids, np.diff(np.append(0, ends[np.cumsum(words) - 1]))

    def _keep_new(self, new: pa.Array) -> None:
        """Encode and remember chunks not seen before."""
        simple = pa.compute.match_substring_regex(new, f"^{LETTERS}$")
        words = new.filter(simple)
        found = self._in_one_call(self.words, pa.compute.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py(), np.ones(len(words), np.int64))
        if found:
            self._keep(words, *found)
            new = new.filter(pa.compute.invert(simple))
        rest = new.to_pylist()
        # a chunk of letters is one word, with one mark after it two; such chunks are encoded in one call
        plain = [c for c in rest if c.isalpha()]
        marked = [c for c in rest if c[-1:] in MARKS and c[:-1].isalpha()]
        found = self._in_one_call(self.tokenizer, " ".join(plain + marked), np.repeat([1, 2], [len(plain), len(marked)]))
        if found:
            self._keep(pa.array(plain + marked, pa.string()), *found)
            rest = list(set(rest).difference(plain, marked))
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self._keep(pa.array(rest, pa.string()), np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(list(map(len, ids)), np.int64))

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where each chunk lies among the known ones; new ones become known."""
        found = chunks.dictionary_encode()
        at = pa.compute.index_in(found.dictionary, value_set=self.known)
        missing, before = at.is_null(), len(self.known)
        at = np.array(pa.compute.fill_null(at, 0), np.int64)
        new = found.dictionary.filter(missing)
        if len(new):
            self._keep_new(new)
            at[np.asarray(missing)] = before + np.asarray(pa.compute.index_in(new, value_set=self.known[before:]))
        return at[np.asarray(found.indices)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > CACHE:
            self.clear()
        texts = [folded(t).replace("\n", " ") for t in texts]
        counts = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
        # chunks are looked up once each, however often they stand in these texts
        found = pa.compute.split_pattern(pa.array([" ".join(texts)]), " ").flatten().dictionary_encode()
        parted = pa.compute.extract_regex(found.dictionary, f"^(?P<word>{LETTERS})(?P<marks>{AFTER}*)$")
        is_parted = parted.is_valid()
        words = self._places(pa.compute.if_else(is_parted, parted.field("word"), found.dictionary))
        marks = self._places(pa.compute.if_else(is_parted, parted.field("marks"), ""))
        both = np.stack([words, marks], axis=1).ravel()
        n = self.lengths[both]
        flat, n = self.ids[ragged(self.starts[both], n)], n.reshape(-1, 2).sum(axis=1)
        at = np.asarray(found.indices)
        lengths = n[at]
        per_chunk = np.append(0, np.cumsum(lengths))
        ends = np.cumsum(counts)
        return flat[ragged((np.cumsum(n) - n)[at], lengths)], np.diff(np.append(0, per_chunk[ends]))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", tag: str = "pieces", with_ids: bool = True) -> DataFrame:
    """Durable table ``doc_id, piece, start, length, ids_crc32`` and, ``with_ids``, ``ids``: each document's ids, then ``end_id``, cut at ``most``.

    ``ids`` are little-endian unsigned 32-bit. A null text is an empty one: its only id is ``end_id``; with
    ``end_id=None`` a document without ids has no piece. Rows that repeat a document give pieces that repeat.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in blocks(batches, "text", 4 << 20):
            ids, n = own.encode([t or "" for t in batch.column("text").to_pylist()])
            docs = np.asarray(batch.column("doc_id"))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            pieces = -(-n // most)
            of = np.repeat(np.arange(len(n)), pieces)
            piece = ragged(np.zeros(len(n), np.int64), pieces)
            length = np.minimum(most, n[of] - piece * most)
            raw = ids.astype("<u4").tobytes()
            at = np.append(0, np.cumsum(length)) * 4
            # pieces lie one after another, so that the block's ids serve as the column's buffer
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            arrays = [pa.array(docs[of], pa.int64()), pa.array(piece, pa.int32()), pa.array(piece * most, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)]))
            yield pa.RecordBatch.from_arrays(arrays, names)
        own.clear()  # other tasks of this worker need the memory

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    rows = framed(docs, id_col, text_col).select("doc_id", "text")
    return durable(rows.mapInArrow(tidy(cut), schema), tag)


def fullest(counts: Counter, capacity: int) -> list[int]:
    """The fullest feasible combination that holds the longest length left, by bitset subset sums.

    Each bit of ``reach`` is a sum that lengths so far can make. Lengths are offered from the longest, as
    often as they are there and fit; among equally full combinations the first found stays.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length] - (length == longest), room // length)):
            after = (reach | reach << length) & mask
            if after == reach:
                break
            steps.append((length, reach))
            reach = after
            if reach >> room:
                break
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, [longest]
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def design(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), until no piece is left.

    Each design uses up at least one length, so there are at most ``capacity`` of them whatever the corpus.
    """
    left, out = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        bin_ = fullest(left, capacity)
        need = Counter(bin_)
        times = min(left[k] // v for k, v in need.items())
        out.append((bin_, times))
        for k, v in need.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def places(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): the ranks of a length that a place of a design takes.

    The bins of a design are numbered one after another; a length that stands k times in it has k places,
    which take consecutive ranges of ranks.
    """
    used, out, sequence = Counter(), [], 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + times - 1, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", salts: int = 0) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as the designs reach.

    Lengths must lie in 1 to ``capacity``. The driver sees one count for each length, never a piece. Ranks within a
    length come from salted windows, whose number follows the count, and from the sums of their sizes,
    so that a length which a third of all pieces share is spread like the others.
    Ties between pieces of one length are settled by ``order``; an empty table stays empty.
    """
    spark = pieces.sparkSession
    n = F.col(length_col).cast("int")
    totals = {int(k): int(v) for k, v in pieces.groupBy(n.alias("n")).count().toLocalIterator()}
    if any(k < 1 or k > capacity for k in totals):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    # about 200,000 pieces of a length in each window
    spread = max([1, *(-(-v // 200_000) for v in totals.values())]) if not salts else salts
    slot = F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int")
    salted = pieces.withColumn("_slot", slot)
    sizes = salted.groupBy(n.alias("_n"), "_slot").agg(F.count("*").alias("_k"))
    base = sizes.select("_n", "_slot", (F.sum("_k").over(Window.partitionBy("_n").orderBy("_slot")) - F.col("_k")).alias("_base"))
    ranked = salted.withColumn("_n", n).withColumn("_rank", F.row_number().over(Window.partitionBy("_n", "_slot").orderBy(*order)) - 1)
    ranked = ranked.join(base, ["_n", "_slot"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # one entry for each place of a design: at most capacity designs with capacity places, looked up in memory
    table: dict[int, list] = {}
    for length, low, _, sequence, offset in places(design(totals, capacity)):
        table.setdefault(length, []).append((low, sequence, offset))
    lookup = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in table.items()}
    shared = spark.sparkContext.broadcast(lookup)

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = np.asarray(length), np.asarray(rank)
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            low, sequence, offset = shared.value[int(k)]
            own = length == k
            at = np.searchsorted(low, rank[own], side="right") - 1
            seq[own], off[own] = sequence[at] + rank[own] - low[at], offset[at]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    placed = ranked.withColumn("_at", place("_n", "_rank"))
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*own, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``.

    * null or empty text: one piece that holds ``end_id`` only
    * only documents longer than ``capacity`` are cut; their last piece may be shorter
    * rows that repeat a document are packed each; an empty table gives an empty result
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity, ("doc_id", "piece"))
