"""Alignment of two tokenizers: token intervals of the same bytes, cut into groups where tokens of both end together.

Texts are cut where neither vocabulary can join what lies on both sides; in each block of texts every different chunk is
encoded once. DuckDB, inside the task, lays the tokens of both sides out as intervals, finds the token that overlaps
another's first byte by an ASOF join, numbers the groups by a window sum and joins them to links. Spark adds up in how
many documents each pair of ids is linked and hands each block the counts that it needs.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, durable, framed, ragged, tidy

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Different chunks whose ids a worker keeps at hand.
CACHE = 200_000
#: Code points from here on are never cut off from their neighbours.
KNOWN = 0x250
#: DuckDB's memory inside a task; beyond, it goes to the task's temporary folder.
MEMORY = "200MB"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def kind(c: int) -> str:
    """L letter, N number, S blank, T line feed, P mark or symbol, U anything else."""
    if c in (0x20, 0x0A):
        return "S" if c == 0x20 else "T"
    major = unicodedata.category(chr(c))[0]
    return major if major in "LN" else "P" if major in "PS" else "U"


class Side:
    """Ids and byte lengths of chunks, flat."""

    def __init__(self) -> None:
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def extend(self, found: list[list[int]]) -> None:
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.starts, self.counts = np.append(self.starts, len(self.ids) + np.cumsum(n) - n), np.append(self.counts, n)
        self.ids = np.append(self.ids, np.fromiter((i for ids in found for i in ids), np.int32, int(n.sum())))


class Encoders:
    """Two vocabularies, where texts may be cut for both, and the ids of chunks seen before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.fromiter(map(len, found), np.int64, len(found)) for found in (self.a_bytes, self.b_bytes)]
        # a line feed keeps the blank that the second vocabulary puts in front away from the chunk
        lead = self.b.encode("\n")
        if [self.b_bytes[i] for i in lead] != [b" ", b"\n"] or any("\n" in p for p in pieces):
            raise ValueError("the second vocabulary has to add a blank in front and spell line feeds as bytes")
        self.lead = len(lead)
        self.cuts = self._cuts(pieces)
        self.clear()

    @staticmethod
    def _cuts(pieces: list[str]) -> np.ndarray:
        """Whether a text may be cut between two code points: the first splits words there whatever follows, no piece of the second holds both."""
        kinds = np.array([kind(c) for c in range(KNOWN)] + ["U"])
        word, mark = np.isin(kinds, ["L", "N"]), kinds == "P"
        white = np.isin(kinds, ["S", "T"])
        no_quote = mark & (np.arange(KNOWN + 1) != ord("'"))  # 's and the like are words of the first
        cut = (word | mark)[:, None] & white[None, :] | (kinds == "T")[:, None] & (word | mark)[None, :]
        cut |= word[:, None] & mark[None, :] | no_quote[:, None] & word[None, :]
        cut |= word[:, None] & word[None, :] & (kinds[:, None] != kinds[None, :])
        for p in pieces:
            for x, y in zip(p.replace("▁", " "), p.replace("▁", " ")[1:]):
                cut[min(ord(x), KNOWN), min(ord(y), KNOWN)] = False
        return cut

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.sides, self.exact = (Side(), Side()), np.zeros(0, bool)

    def chunks(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All chunks of all texts one after another, each text with a blank in front, and how many each text has."""
        joined = "".join(" " + t for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.minimum(raw, KNOWN)
        cut = np.zeros(len(raw), bool)
        cut[1:] = self.cuts[at[:-1], at[1:]]
        # a line feed is cut off only where no other white space stands before it
        cut[2:] &= ~((raw[1:-1] == 0x0A) & ~self.cuts[at[:-2], at[1:-1]])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut[begins[:-1]] = True
        place = np.append(0, np.cumsum(1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)))
        starts = np.flatnonzero(cut)
        offsets = np.append(place[starts], place[-1]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode()))
        return found.dictionary_encode(), np.diff(np.searchsorted(starts, begins))

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Where ``sides`` and ``exact`` have these chunks."""
        if len(self.code) > CACHE:
            self.clear()
        new = [c for c in chunks if c not in self.code]
        if new:
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            b = [ids[self.lead :] for ids in self.b.encode(["\n" + c for c in new], num_threads=1)]
            for side, found in zip(self.sides, (a, b), strict=True):
                side.extend(found)
            exact = [b"".join([self.a_bytes[i] for i in x]) == (raw := c.encode()) == b"".join([self.b_bytes[i] for i in y]) for c, x, y in zip(new, a, b, strict=True)]
            self.exact = np.append(self.exact, exact)
        return np.array([self.code[c] for c in chunks], np.int64)

    def intervals(self, codes: np.ndarray) -> list[pa.Table]:
        """For both sides ``chunk, id, s, e``: the tokens of chunks laid end to end, by the chunk's place in ``codes``."""
        out = []
        for side, length in zip(self.sides, self.lengths, strict=True):
            n = side.counts[codes]
            ids = side.ids[ragged(side.starts[codes], n)]
            e = np.cumsum(length[ids])
            out.append(pa.table({"chunk": np.repeat(np.arange(len(codes), dtype=np.int32), n), "id": ids, "s": e - length[ids], "e": e}))
        return out


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(a_path: str, b_path: str) -> Encoders:
    """One for each worker process."""
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Encoders(a_path, b_path)
    return _encoders[a_path, b_path]


#: From interval tables ``a`` and ``b`` to groups, links of each chunk, and pairs of ids.
STEPS = (
    # a group ends where tokens of both sides end
    """CREATE OR REPLACE TEMP TABLE ga AS
       SELECT chunk, id, s, coalesce(sum(ends) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
       FROM (SELECT a.*, (b.e IS NOT NULL)::INT AS ends FROM a LEFT JOIN b ON a.e = b.e)""",
    # a token of the other side is in the group of the token that overlaps its first byte
    "CREATE OR REPLACE TEMP TABLE gb AS SELECT b.chunk, b.id, b.s, ga.g FROM b ASOF JOIN ga ON b.s >= ga.s",
    # links by counts of equal ids, so a group of many tokens isn't multiplied out
    """CREATE OR REPLACE TEMP TABLE links AS
       SELECT chunk, a, b, sum(na * nb)::BIGINT AS m
       FROM (SELECT chunk, g, id AS a, count(*) AS na FROM ga GROUP BY ALL) JOIN (SELECT g, id AS b, count(*) AS nb FROM gb GROUP BY ALL) USING (g)
       GROUP BY ALL""",
    "CREATE OR REPLACE TEMP TABLE pairs AS SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS p, a, b FROM (SELECT DISTINCT a, b FROM links)",
    "CREATE OR REPLACE TEMP TABLE linked AS SELECT chunk, p, m FROM links JOIN pairs USING (a, b) ORDER BY chunk, p",
)
#: In how many documents of the block each pair is linked.
HELD = "SELECT p, a, b, docs FROM pairs JOIN (SELECT p, count(*) AS docs FROM (SELECT DISTINCT doc, p FROM held JOIN linked USING (chunk)) GROUP BY p) USING (p) ORDER BY p"

BLOCK_SCHEMA = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, groups array<string>, "
    "n_chunks array<int>, chunks binary, n_linked binary, linked_p binary, linked_m binary, p array<int>, a array<int>, b array<int>, docs array<int>"
)


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte planes, compressed: the high ones are nearly all zero."""
    raw = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * n, asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def summed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``x``, ``n`` numbers each; none may be many or none."""
    total = np.append(0, np.cumsum(x, dtype=np.int64))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def group_texts(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> list[str]:
    """Each chunk's groups as text: the ids of both sides with a bar between, groups parted by semicolons.

    ``groups`` are the tokens' group numbers, which rise; ``ends`` holds the last group of each chunk.
    """
    if not len(ends):
        return []
    (a, b), (ga, gb) = ids, groups
    # a token's place: those of its own side before it, and all of the other side's earlier groups
    place = (np.arange(len(a)) + np.searchsorted(gb, ga, side="left"), np.arange(len(b)) + np.searchsorted(ga, gb, side="right"))
    out, mark = np.zeros(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), np.int8)
    out[place[0]], out[place[1]] = a, b
    mark[place[0][np.append(ga[1:] != ga[:-1], True)]] = 1
    last = np.flatnonzero(np.append(gb[1:] != gb[:-1], True))
    mark[place[1][last]] = 2
    stops = last[ends]
    mark[place[1][stops]] = 3
    pieces = pa.compute.binary_join_element_wise(pa.array(out).cast(pa.string()), pa.DictionaryArray.from_arrays(pa.array(mark), [",", "|", ";", ""]).cast(pa.string()), "")
    offsets = np.append(0, place[1][stops] + 1).astype(np.int32)
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pieces), "").to_pylist()


def aligned_block(con: object, own: Encoders, doc_ids: list[int], texts: list[str], with_groups: bool) -> dict[str, object]:
    """The columns of ``BLOCK_SCHEMA`` but ``block``, for some documents."""
    chunks, n_chunks = own.chunks(texts)
    words, at = chunks.dictionary.to_pylist(), np.asarray(chunks.indices).astype(np.int64)
    codes = own.codes(words)
    exact = own.exact[codes]
    n_chunks[np.array([not t for t in texts], bool)] *= -1  # an empty text has no tokens
    n_chunks[(n_chunks > 0) & (summed(~exact[at], np.abs(n_chunks)) > 0)] *= -1
    at, n_chunks = at[np.repeat(n_chunks > 0, np.abs(n_chunks))], np.maximum(n_chunks, 0)
    # only chunks of texts that have tokens count, in order of their first use
    used = np.zeros(len(codes), bool)
    used[at] = True
    number = np.cumsum(used) - 1
    at, codes = number[at], codes[used]
    a, b = own.intervals(codes)
    con.register("a", a)
    con.register("b", b)
    for step in STEPS:
        con.execute(step)
    owner = np.repeat(np.arange(len(texts)), n_chunks)
    held = np.unique(owner << 32 | at)
    con.register("held", pa.table({"doc": (held >> 32).astype(np.int32), "chunk": (held & 0xFFFFFFFF).astype(np.int32)}))
    linked = con.sql("SELECT chunk, p, m FROM linked ORDER BY chunk, p").to_arrow_table()
    group_of = [np.asarray(con.sql(f"SELECT g FROM {t} ORDER BY s").to_arrow_table()["g"]) for t in ("ga", "gb")]
    pairs = con.sql(HELD).to_arrow_table()
    n_linked = np.bincount(np.asarray(linked["chunk"]), minlength=len(codes))
    m = np.asarray(linked["m"]).astype(np.int64)
    if len(m) and m.max() >= 1 << 32:
        raise OverflowError("over 2^32 links of one pair in one chunk")
    last_groups = group_of[0][np.cumsum(own.sides[0].counts[codes]) - 1]
    text_of = np.array(group_texts((np.asarray(a["id"]), np.asarray(b["id"])), tuple(group_of), last_groups), object)
    each = [";".join(text_of[at[e - n : e]].tolist()) for e, n in zip(np.cumsum(n_chunks).tolist(), n_chunks.tolist(), strict=True)]
    per_chunk = {"n_a": own.sides[0].counts[codes], "n_b": own.sides[1].counts[codes], "n_groups": np.diff(last_groups, prepend=-1), "n_links": summed(m, n_linked)}
    out = {"doc_id": doc_ids, **{c: summed(x[at], n_chunks).tolist() for c, x in per_chunk.items()}}
    out["sha"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in each]
    out["groups"] = each if with_groups else []
    out |= {"n_chunks": n_chunks.tolist(), "chunks": packed(at), "n_linked": packed(n_linked), "linked_p": packed(np.asarray(linked["p"])), "linked_m": packed(m)}
    return out | {c: pairs[c].to_pylist() for c in ("p", "a", "b", "docs")}


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Durable table with a row for each block of texts, as ``BLOCK_SCHEMA`` has it."""
    schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split(" ") for x in BLOCK_SCHEMA.split(", "))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        own, con = encoders(a_path, b_path), duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held)
            held.clear()
            number += 1
            found = aligned_block(con, own, rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()], with_groups)
            return pa.RecordBatch.from_pylist([{"block": number, **found}], schema)

        size = 0
        for batch in blocks(batches, "text", BLOCK):
            if held and size + batch.nbytes > BLOCK:
                yield done()
                size = 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield done()
        con.close()
        own.clear()

    return durable(framed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(tidy(align), BLOCK_SCHEMA), "token-blocks")


def pair_counts(blocks_: DataFrame) -> DataFrame:
    """Durable ``a, b, n, best``: in how many documents a pair of ids is linked, and whether no other has more for its ``a``."""
    rows = blocks_.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("x")).select("x.a", "x.b", "x.docs")
    counts = durable(rows.groupBy("a", "b").agg(F.sum("docs").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as the vocabulary has ids at most
    found = durable(counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    return found


def cross_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """How the tokens of a byte-level vocabulary and of one of pieces lie over each other in every document.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, ``with_groups``, ``groups``: as text, the ids of both sides
    in each group, like ``a1,a2|b1;a3|b2,b3``. Links are all pairs of tokens of both sides in one group; a pair of ids counts once for each document that
    has it linked; ``n_best`` are the links whose count is the highest of their first id, ``count_sum`` adds up the counts of all links.

    * null and empty texts, and texts whose tokens of either side don't spell a blank and the text, byte by byte, have no tokens: zeros, and ''
    * special tokens' names inside a text are plain text; very long texts are one block by themselves
    * rows that repeat a document or its id are documents each; rows without an id are left out and count for nobody
    * an empty table gives an empty result; input columns of any name don't matter

    A task holds one block of texts; pairs of ids are counted in the block, then by Spark. Each block gets back the counts of its own pairs only.
    """
    found = aligned_blocks(docs, a_path, b_path, id_col, text_col, with_groups)
    counts = pair_counts(found)
    wanted = found.select("block", F.explode(F.arrays_zip("p", "a", "b")).alias("x")).select("block", "x.p", "x.a", "x.b")
    sliced = durable(wanted.join(counts, ["a", "b"]).select("block", "p", "n", "best"), "pair-slices")
    discard(counts)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = ", ".join(f"{c} {'string' if c.startswith('groups') else 'bigint'}" for c in names)

    def fold(block: pa.Table, pairs: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        p = np.asarray(pairs["p"])
        n[p], best[p] = np.asarray(pairs["n"]), np.asarray(pairs["best"])
        n_chunks = np.array(row["n_chunks"], np.int64)
        at = unpacked(row["chunks"], int(n_chunks.sum()))
        n_linked = unpacked(row["n_linked"], int(at.max()) + 1 if len(at) else 0)
        linked, m = (unpacked(row[c], int(n_linked.sum())) for c in ("linked_p", "linked_m"))
        sums = [summed(summed(m * x[linked], n_linked)[at], n_chunks) for x in (best, n)]
        columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["sha"], *[row["groups"]] * with_groups]
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))

    left = found.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "n_chunks", "chunks", "n_linked", "linked_p", "linked_m")
    return left.groupBy("block").cogroup(sliced.groupBy("block")).applyInArrow(fold, schema)
