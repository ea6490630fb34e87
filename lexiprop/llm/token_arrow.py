"""Token ids in Arrow stream files of fixed-size-list batches.

Documents go in doc_id order through range partitions; each task encodes its documents, adds
the end id to each, and packs the ids into sequences of equal length with a mask (0 marks the
padding of a file's last sequence). All batches of a file but the last have the same number of
sequences, so a reader that maps the file into memory finds sequence i without copying. Beside
each file of sequences lies one with the documents' places in it. File names carry the task
attempt; only files of attempts that finished get into the manifest, so a lost executor leaves
no wrong file in it.

Defined cases: a null text is empty and gives the end id alone; rows without a doc_id come
first; rows that share a doc_id each come out, in the order of their text's hash; an empty
table gives no files' rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiprop.llm import bpe_words
from lexiprop.llm.common import column, shared_path, stored

SEQUENCE, BATCH, END_ID = 2048, 64, 2


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class SequenceWriter:
    """Packs ids into batches of ``batch`` sequences of ``length`` ids."""

    def __init__(self, path: str, dtype: str, length: int = SEQUENCE, batch: int = BATCH):
        where, name = _file(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.length, self.full, self.dtype = length, length * batch, dtype
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = where.open_output_stream(name)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.full:
            every = np.concatenate(self.held)
            for i in range(0, len(every) - self.full + 1, self.full):
                self._write(every[i : i + self.full], self.full)
            rest = every[len(every) // self.full * self.full :]
            self.held, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """A written file; sequences and masks are views of it (of the mapped file, where it is local)."""

    def __init__(self, path: str):
        where, name = _file(path)
        local = where.type_name == "local"
        self.source = pa.memory_map(name) if local else where.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.ids = [b.column(0).flatten().to_numpy() for b in self.batches]
        self.masks = [b.column(1).flatten() for b in self.batches]
        self.length = self.batches[0].schema.field(0).type.list_size if self.batches else 0
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (one bit an id) of sequence ``i``, without a copy."""
        b, r = divmod(i, self.per_batch)
        at = r * self.length
        return self.ids[b][at : at + self.length], self.masks[b].slice(at, self.length)

    def runs(self, start: int, n: int):
        """The ids from ``start`` on, ``n`` of them, as views of one batch each."""
        full = self.per_batch * self.length
        while n:
            b, r = divmod(start, full)
            view = self.ids[b][r : r + n]
            if not len(view) or not self.masks[b][r + len(view) - 1].as_py():
                raise ValueError("the file ends before the ids that were asked for")
            yield view
            start, n = start + len(view), n - len(view)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the files below ``path`` and returns the manifest ``(part, ids_file, places_file, n_docs, n_tokens)``.

    ``tokenizer`` is the tokenizer's file. The ids are unsigned 16-bit where they fit.
    """
    model = bpe_words.tokenizer_text(tokenizer)
    dtype = "<u2" if max(bpe_words.load(model).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    text = column(docs, "text", "string")
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, out, places = bpe_words.worker_encoder(model, dtype), None, []
        end = np.array([end_id], dtype).tobytes()
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for i, some in bpe_words.batches_of(b.column(1).to_pylist()):
                out = out or SequenceWriter(f"{name}.arrow", dtype, length, batch)
                for doc_id, data in zip(ids_of[i : i + len(some)], encoder.encode(some)):
                    ids = np.frombuffer(data + end, dtype)
                    places.append((doc_id, out.total, len(ids)))
                    out.add(ids)
        if out is None:
            return
        out.close()
        doc_ids, starts, counts = zip(*places)
        table = pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "start", "n_tokens"])
        where, file = _file(f"{name}.places.arrow")
        with where.open_output_stream(file) as sink, pa.ipc.new_stream(sink, table.schema) as w:
            w.write_batch(table)
        yield pa.RecordBatch.from_pylist(
            [{"part": task.partitionId(), "ids_file": f"{name}.arrow", "places_file": f"{name}.places.arrow", "n_docs": len(places), "n_tokens": out.total}]
        )

    return stored(ordered.mapInArrow(run, "part long, ids_file string, places_file string, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files of ``manifest``.

    ``start`` counts the ids of all documents before it, over all files.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                file = SequenceFile(row["ids_file"])
                where, name = _file(row["places_file"])
                with where.open_input_file(name) as source:
                    places = pa.ipc.open_stream(source).read_all()
                sums = []
                for start, n in zip(places["start"].to_pylist(), places["n_tokens"].to_pylist()):
                    crc = 0
                    for view in file.runs(start, n):
                        crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                start = pa.array(places["start"].to_numpy() + row["base"])
                yield pa.RecordBatch.from_arrays(
                    [places["doc_id"].combine_chunks(), start, places["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a task for each file
    files = based.select("ids_file", "places_file", "base").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "tokens")
