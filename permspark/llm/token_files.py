"""Token ids in Arrow files of fixed-size lists.

Documents are range-sorted by doc_id and encoded; their ids, each document's followed by an end id, form one stream, which is cut into
sequences of equal length. A file holds record batches of equal size with three fixed-size-list columns: input_ids, attention_mask (false
where a file's last sequence is filled up) and document_end (true on each end id). The Arrow file footer says where each batch begins, so a
sequence is found by two divisions and read from the mapped file without copying. Beside each file stands an index of its
documents (doc_id and first position). A document isn't divided between files. The manifest, one row for each file, gives the order.

A null text is encoded as empty: the end id alone. Null ids come first, equal ids stand together in the order of their texts'
hashes, repeated rows are repeated. Other columns are ignored. An empty table makes no file and gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from permspark.llm.ordered import parallelism
from permspark.llm.shared_files import located, partition, published
from permspark.llm.text import text_key
from permspark.sources.writers import scratch_dir, staged

END_ID = 1
LENGTH = 1024
SEQUENCES = 128
#: Ids after which a file ends, at the end of a document.
FILE_IDS = 1 << 23
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 400_000

#: Texts of these characters only are cut at white space, which the tokenizer drops, and encoded piece by piece. They have no
#: combining marks and one lower-case form, so a piece's ids don't depend on its neighbours.
PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]")
MARKS = ".,;:!?%&$#*|\")]}"


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_byte = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # pieces need a tokenizer that drops white space, lower-cases, and ends every word by itself
        self.by_piece = self._whole("Ab, c") == self._whole("ab") + self._whole(",") + self._whole("c") == self._whole("ab\n,\tc")
        model = self.tokenizer.model
        self.by_model = self.by_piece and self._pack(t.id for t in model.tokenize("rein")) == self._whole("rein")

    def _pack(self, ids) -> bytes:
        return np.fromiter(ids, dtype=self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without white space: the word, and the marks that follow it."""
        word = piece.rstrip(MARKS)
        if word != piece and word and word[-1].isalnum():
            ids = self._remembered(word) + self._remembered(piece[len(word) :])
        elif self.by_model and piece.isalpha():
            mapped = piece if piece.isascii() else self.by_byte.pre_tokenize_str(piece)[0][0]
            ids = self._pack(t.id for t in self.tokenizer.model.tokenize(mapped))
        else:
            ids = self._whole(piece)
        return ids

    def _remembered(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self._piece(piece)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or PLAIN.search(text) or (self.added and self.added.search(text)):
            return self._whole(text)
        known, pieces = self.known, text.lower().split()
        found = [known.get(p) for p in pieces]
        if None in found:
            found = [self._remembered(p) if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def schema(kind: np.dtype, length: int) -> pa.Schema:
    ids = pa.from_numpy_dtype(kind)
    return pa.schema(
        [("input_ids", pa.list_(ids, length)), ("attention_mask", pa.list_(pa.bool_(), length)), ("document_end", pa.list_(pa.bool_(), length))]
    )


class FileWriter:
    """Packs the ids of whole documents into the batches of one file."""

    def __init__(self, out: pa.NativeFile, kind: np.dtype, length: int, sequences: int):
        self.kind, self.length, self.size = kind, length, length * sequences
        self.schema = schema(kind, length)
        self.writer = ipc.new_file(out, self.schema)
        self.held, self.ends, self.begun, self.total = bytearray(), [], 0, 0
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes, end: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.total)
        self.held += ids
        self.held += end
        self.total += (len(ids) + len(end)) // self.kind.itemsize
        self.ends.append(self.total - 1)
        if len(self.held) >= self.size * self.kind.itemsize:
            self._write(len(self.held) // (self.size * self.kind.itemsize) * self.size)

    def _write(self, n: int) -> None:
        ids = np.frombuffer(bytes(self.held[: n * self.kind.itemsize]), dtype=self.kind)
        del self.held[: n * self.kind.itemsize]
        whole = -(-len(ids) // self.length) * self.length
        mask, last = np.zeros(whole, dtype=bool), np.zeros(whole, dtype=bool)
        mask[: len(ids)] = True
        here = [e for e in self.ends if e < self.begun + len(ids)]
        last[np.array(here, dtype=np.int64) - self.begun] = True
        self.ends = self.ends[len(here) :]
        ids = np.concatenate([ids, np.zeros(whole - len(ids), dtype=self.kind)])
        self.begun += len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, last)]
        for batch in pa.Table.from_arrays(columns, schema=self.schema).to_batches(max_chunksize=self.size // self.length):
            self.writer.write_batch(batch)

    def close(self) -> pa.Table:
        """The index: doc_id and first position of each document."""
        if self.held:
            self._write(len(self.held) // self.kind.itemsize)
        self.writer.close()
        return pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "start": pa.array(self.starts, pa.int64())})


class TokenFile:
    """Random access to the sequences of one file; a local file is mapped and nothing is copied."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def batches(self) -> Iterator[tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]]:
        """Flat ids and masks of each batch."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            yield batch.column(0).flatten().to_numpy(), batch.column(1).flatten(), batch.column(2).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Ids, attention mask and document ends of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // self.per_batch), i % self.per_batch
        cut = slice(row * self.length, (row + 1) * self.length)
        ids, mask, last = (batch.column(c).flatten() for c in range(3))
        return ids[cut].to_numpy(), mask[cut], last[cut]


def writing(folder: str, path: str, end_id: int, length: int, sequences: int, file_ids: int) -> Callable:
    """Task: encodes sorted documents (doc_id, text) into files and returns their rows of the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path)
        end = np.array([end_id], dtype=codes.kind).tobytes()
        rows = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        row, number = next(rows, None), 0
        while row is not None:
            uri = f"{folder}/ids-{partition():06d}-{number:05d}.arrow"
            with published(uri) as out:
                file = FileWriter(out, codes.kind, length, sequences)
                while row is not None and file.total < file_ids:
                    file.add(row[0], codes.encode(row[1]), end)
                    row = next(rows, None)
                index = file.close()
            with published(f"{uri}.index") as out, ipc.new_file(out, index.schema) as writer:
                writer.write_table(index)
            yield pa.RecordBatch.from_pydict(
                {"uri": [uri], "part": [partition()], "number": [number], "n_docs": [len(index)], "n_ids": [file.total]},
                schema=pa.schema([("uri", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )
            number += 1

    return write


def write_tokens(
    docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, length: int = LENGTH,
    sequences: int = SEQUENCES, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files to a shared folder and returns the manifest: uri, part, number, n_docs, n_ids and first (ids before the file)."""
    folder = folder or scratch_dir(docs.sparkSession)
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_h"))
    dealt = rows.repartitionByRange(parallelism(docs), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    made = dealt.mapInArrow(
        writing(folder, path, end_id, length, sequences, file_ids), "uri string, part long, number long, n_docs long, n_ids long"
    )
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return staged(made).withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def file_documents(uri: str, first: int) -> pa.RecordBatch:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in a file, from its ids and masks."""
    system, path = located(f"{uri}.index")
    with system.open_input_file(path) as source:
        index = ipc.open_file(source).read_all()
    lengths, sums, crc, size = [], [], 0, 0
    for ids, mask, last in TokenFile(uri).batches():
        ids = ids[: mask.true_count].astype("<u4")
        data, at = memoryview(ids).cast("B"), 0
        for end in np.flatnonzero(last.to_numpy(zero_copy_only=False)).tolist():
            sums.append(zlib.crc32(data[4 * at : 4 * (end + 1)], crc))
            lengths.append(size + end + 1 - at)
            crc, size, at = 0, 0, end + 1
        crc, size = zlib.crc32(data[4 * at :], crc), size + len(ids) - at
    starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, dtype=np.int64)
    if len(lengths) != len(index) or not np.array_equal(starts, index.column("start").to_numpy()):
        raise ValueError(f"the index of {uri} doesn't match its masks")
    return pa.RecordBatch.from_pydict(
        {"doc_id": index.column("doc_id").combine_chunks(), "start": pa.array(starts + first, pa.int64()),
         "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
    )


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield file_documents(uri, first)


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("uri", "first").repartition(parallelism(manifest), "uri")
    return files.mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")
