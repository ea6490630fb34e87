"""BPE over a table of distinct words.

1. Texts are cut into words where they are read. Documents are held in blocks; a block writes
   each of its distinct words once, and its documents as positions in that list of words.
2. The blocks' word lists are shuffled by word. Each distinct word is encoded once, and its
   ids are joined with the id-to-piece table (its size is the vocabulary's).
3. The lists go back to their blocks, where ids and pieces take the words' positions.

So a word that fills a third of a corpus is one entry for each block, and no text is shuffled,
only positions. Blocks and word buckets have bounded sizes.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and
rows without a doc_id each come out; a text longer than a block is a block alone; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.llm import bpe_words
from lexiprop.llm.common import column, release_memory, stored, texts_of

#: Bytes of text in a block, parts the words are dealt into, and words remembered while a part is encoded.
BLOCK_BYTES, BUCKETS, ROOM = 32 << 20, 64, 1 << 20
_ROWS = "block string, bucket int, words binary, at binary, docs array<long>, lengths array<long>"
_DOCS = -1


def _pack(data: bytes) -> bytes:
    """The length of ``data``, the packed length and the packed bytes."""
    packed = pa.compress(data, codec="zstd", asbytes=True)
    return len(data).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed


def _unpack(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """What was packed at ``at``, and where it ends."""
    size, packed = (int.from_bytes(data[at + i : at + i + 8], "little") for i in (0, 8))
    end = at + 16 + packed
    return pa.decompress(data[at + 16 : end], size, codec="zstd", asbytes=True), end


def _planes(values: np.ndarray) -> bytes:
    """Integers with their lowest bytes first, then the next, which packs well."""
    return b"".join([_pack((values >> np.uint32(shift)).astype(np.uint8).tobytes()) for shift in (0, 8, 16, 24)])


def _values(data: bytes) -> np.ndarray:
    out, at = None, 0
    for shift in (0, 8, 16, 24):
        plane, at = _unpack(data, at)
        plane = np.frombuffer(plane, np.uint8)
        out = np.zeros(len(plane), "<u4") if out is None else out
        out |= plane.astype("<u4") << np.uint32(shift)
    return out


class Block:
    """Documents as positions in a list of distinct words."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number, length = self.number, 0
        for segment in bpe_words.segments(text):
            words = bpe_words.words(segment)
            for w in words:
                if w not in number:
                    number[w] = len(number)
            self.codes.append(np.array([number[w] for w in words], np.uint32))
            length += len(words)
        self.docs.append(doc_id)
        self.lengths.append(length)
        self.bytes += len(text or "")

    def rows(self, name: str, buckets: int):
        """The word lists by bucket, then the documents."""
        codes = np.concatenate([np.empty(0, np.uint32), *self.codes])
        self.codes.clear()
        # the commonest words get the smallest numbers, which pack best
        order = np.argsort(-np.bincount(codes, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        by: list[list[str]] = [[] for _ in range(buckets)]
        for w in self.number:
            by[zlib.crc32(w.encode()) % buckets].append(w)
        for bucket, words in enumerate(by):
            if words:
                words.sort()
                at = rank[[self.number[w] for w in words]]
                yield name, bucket, _pack("\n".join(words).encode()), _planes(at), None, None
        if len(codes):
            np.take(rank, codes, out=codes)
        yield name, _DOCS, None, _planes(codes), self.docs, self.lengths


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """The blocks of ``docs``, stored: for each its words by bucket, and a row of documents (bucket -1)."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        task, n, block = TaskContext.get(), 0, Block()

        def full():
            nonlocal n, block
            for row in block.rows(f"{task.partitionId()}-{task.taskAttemptId()}-{n}", buckets):
                yield _batch([row], names, kinds)
            n, block = n + 1, Block()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b, 1)):
                if block.docs and block.bytes + len(text or "") > block_bytes:
                    yield from full()
                block.add(doc_id, text)
        if block.docs:
            yield from full()
        del block
        release_memory()

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return stored(rows.mapInArrow(run, _ROWS), "blocks")


def encode_buckets(blocks: DataFrame, model: str, room: int = ROOM) -> DataFrame:
    """``(block, bucket, ids, counts, at)``: for each block's words of a bucket their ids, one after
    another, how many each word has, and the words' positions. A bucket's blocks meet in one
    task, which encodes each distinct word once."""
    words = blocks.filter(F.col("bucket") >= 0).select("block", "bucket", "words", "at")
    met = words.repartition("bucket").sortWithinPartitions("bucket", "block")

    def run(batches):
        coder = bpe_words.worker_coder(model)
        known: dict[str, list[int]] = {}
        bucket = None
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != bucket or len(known) > room:
                    known.clear()
                    bucket = row["bucket"]
                own = _unpack(row["words"])[0].decode().split("\n")
                new = [w for w in own if w not in known]
                known.update(zip(new, coder.encode(new)))
                ids = [known[w] for w in own]
                flat = np.array([i for x in ids for i in x], "<u4")
                counts = np.array([len(x) for x in ids], "<u4")
                yield _batch(
                    [(row["block"], bucket, _planes(flat), _planes(counts), row["at"])],
                    ["block", "bucket", "ids", "counts", "at"],
                    [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()],
                )
        known.clear()
        release_memory()

    return met.mapInArrow(run, "block string, bucket int, ids binary, counts binary, at binary")


def encode_documents(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS, room: int = ROOM, with_results: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row; with ``with_results`` also
    the ``ids`` (array) and the ``decoded`` text. ``tokenizer`` is the tokenizer's file."""
    model = bpe_words.tokenizer_text(tokenizer)
    blocks = word_blocks(docs, block_bytes, buckets)
    encoded = encode_buckets(blocks, model, room).select("block", "bucket", "ids", "counts", "at", *[F.lit(None).cast("array<long>").alias(c) for c in ("docs", "lengths")])
    positions = blocks.filter(F.col("bucket") == _DOCS).select(
        "block", F.lit(2**31 - 1).alias("bucket"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "counts")], "at", "docs", "lengths"
    )
    met = encoded.unionByName(positions).repartition("block").sortWithinPartitions("block", "bucket")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_results else 4]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()][: len(names)]

    def results(table: list[str], lists: list[dict], row: dict):
        """A block's documents, from the id-to-piece table, its word lists and its row of positions."""
        ids = np.concatenate([np.empty(0, "<u4"), *(_values(x["ids"]) for x in lists)])
        counts = np.concatenate([np.empty(0, "<u4"), *(_values(x["counts"]) for x in lists)]).astype(np.int64)
        at = np.concatenate([np.empty(0, "<u4"), *(_values(x["at"]) for x in lists)])
        first, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        first[at] = np.cumsum(counts) - counts
        n[at] = counts
        pieces = [table[i] for i in ids.tolist()]
        decoded = [" ".join(pieces[a : a + k]) for a, k in zip(first.tolist(), n.tolist())]
        codes, start = _values(row["at"]), 0
        for doc_id, length in zip(row["docs"], row["lengths"]):
            c = codes[start : start + length]
            start += length
            c = c[n[c] > 0]
            k = n[c]
            ends = np.cumsum(k)
            total = int(ends[-1]) if len(k) else 0
            own = ids[np.repeat(first[c] - (ends - k), k) + np.arange(total)]
            text = " ".join([decoded[i] for i in c.tolist()])
            shas = [hashlib.sha256(x).hexdigest() for x in (own.tobytes(), text.encode())]
            yield (doc_id, total, *shas, own.tolist(), text)[: len(names)]

    def run(batches):
        t = bpe_words.worker_coder(model).tokenizer
        table = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        lists: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if row["docs"] is None:
                    lists.append(row)
                    continue
                out: list[tuple] = []
                for r in results(table, lists, row):
                    out.append(r)
                    if len(out) == 1000:
                        yield _batch(out, names, kinds)
                        out = []
                if out:
                    yield _batch(out, names, kinds)
                lists = []
        release_memory()

    kinds_sql = ["long", "long", "string", "string", "array<long>", "string"]
    return met.mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(names, kinds_sql)))
