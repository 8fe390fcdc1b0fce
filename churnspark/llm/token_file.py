"""Token ids in Arrow files: fixed-size-list batches for zero-copy access to equal-length sequences and their masks.

Documents are range-partitioned and sorted by id; each task encodes its range and streams the ids into one Arrow IPC file
of record batches (``ids``: fixed-size list of unsigned integers, ``SEQUENCE`` values a row, read as views of the memory map; ``length``: how many
of them are tokens). Every document ends with the end id; sequences follow each other without gaps, only the last one of a
file is padded. So the masks of a batch (1 for tokens, 0 for padding) are a run of ones and a run of zeros: a view of a constant, which takes no
room in the file. A batch always holds ``BATCH`` sequences (but for a file's last), so token ``t`` of a file
is value ``t % SEQUENCE`` of row ``t // SEQUENCE`` and a memory-mapped file gives any sequence as a view. ``index``
rows (document, file, offset, length) and a file list go with the files; files of lost or repeated task attempts
have names of their own and are not in the list.

No text reaches the driver; the memory of a task is a batch of texts, a batch of sequences and the words remembered.

Defined cases: null text counts as empty (one token, the end id); rows with a null id come first; rows with the same id
each have an entry, in any fixed order; an empty table writes no file and an empty index; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.alignment import byte_alphabet
from churnspark.llm.common import scratch

SEQUENCE = 1024
BATCH = 128
#: Bytes of input behind one file at most (as the plan estimates them).
FILE_BYTES = 256 << 20
#: Any batch's masks, one after the other, are a slice of this.
_MASKS = np.repeat(np.array([1, 0], np.uint8), [SEQUENCE * BATCH, SEQUENCE])
_MASKS.flags.writeable = False
_SPLIT = re.compile("[ \t\n\r]+").split
#: Texts encoded together, words that a Python worker remembers.
AT_ONCE, REMEMBERED = 500, 350_000
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch


def byte_characters() -> list[str]:
    """Byte -> character of a byte-level vocabulary."""
    return [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]


class Encoder:
    """Ids of whole texts as bytes, by the tokenizers library.

    A tokenizer that drops white space and marks word ends (``</w>``) encodes words independently, so only words not seen
    lately go through the library; the others are remembered. Of a simple word (letters, then ASCII marks but no apostrophe) normal form and pieces
    are known, so its pieces go to the library's model at once, byte by byte as its byte-level step writes them. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(*vocabulary.values(), end_id) < 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.by_word = json.load(f)["model"].get("end_of_word_suffix") == "</w>"
        self.codes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(max(vocabulary.values()) + 1)]
        # the byte-level form of the letters of simple words beyond ASCII
        self.letters = str.maketrans({c: "".join(map(byte_characters().__getitem__, c.encode())) for c in map(chr, range(0xDF, 0x100))})
        self.end = self._bytes([end_id])
        self.seen: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words, with A-Z lower-cased first where the tokenizer's own normal form makes that the same."""
        if "<|" in text:  # special tokens are found before lower-casing
            return _SPLIT(text)
        if text.isascii():
            # the four separators count as blanks in Python only
            return _SPLIT(text.lower()) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.lower().split()
        low = text.encode().lower().decode()
        same = unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return _SPLIT(low if same else text)

    def _learn(self, words: set[str]) -> None:
        seen, codes, tokenize = self.seen, self.codes, self.tokenizer.model.tokenize
        for w in words:
            m = _SIMPLE(w)
            if m and w:
                letters, marks = m.groups()
                tokens = tokenize(letters if letters.isascii() else letters.translate(self.letters)) if letters else []
                if marks:
                    tokens += tokenize(marks)
                seen[w] = b"".join([codes[t.id] for t in tokens])
            else:
                seen[w] = self._bytes(self.tokenizer.encode(w, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [self._bytes(e.ids) + self.end for e in found]
        split = [self._words(t) if t else [] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        self._learn(set().union(*split).difference(seen))
        return [b"".join(map(seen.__getitem__, ws)) + self.end for ws in split]


@lru_cache(maxsize=2)
def load_encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker; it outlives the task."""
    return Encoder(path, end_id)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class SequenceWriter:
    """Streams ids into one Arrow file of equal-length sequences."""

    def __init__(self, path: str, dtype: np.dtype):
        self.fs, where = _open(path)
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("length", pa.uint16())])
        self.fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(where)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.dtype, self.waiting, self.count, self.total = dtype, [], 0, 0

    def add(self, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.waiting.append(ids)
        self.count += n
        self.total += n
        if self.count >= SEQUENCE * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.waiting), self.dtype)
        step, at = SEQUENCE * BATCH, 0
        while len(values) - at >= step or (last and at < len(values)):
            part = values[at:at + step]
            rows = -(-len(part) // SEQUENCE)
            ids = np.zeros(rows * SEQUENCE, self.dtype)
            ids[:len(part)] = part
            lengths = np.minimum(len(part) - SEQUENCE * np.arange(rows), SEQUENCE).astype(np.uint16)
            self.file.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), SEQUENCE), pa.array(lengths)], schema=self.schema))
            at += len(part)
        rest = values[at:].tobytes()
        self.waiting, self.count = ([rest] if rest else []), len(values) - at

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.sink.close()


class SequenceFile:
    """Random access to a file: batches are views into the memory map (local files) or read when wanted."""

    def __init__(self, path: str):
        fs, where = _open(path)
        self.source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.file = pa.ipc.open_file(self.source)
        self.last = (None, None)

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows x SEQUENCE) ids and mask of batch ``i``."""
        if self.last[0] != i:
            b = self.file.get_batch(i)
            ids, lengths = b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).to_numpy()
            begin = SEQUENCE * BATCH - int(lengths.sum(dtype=np.int64))
            self.last = (i, (ids.reshape(-1, SEQUENCE), _MASKS[begin:begin + len(ids)].reshape(-1, SEQUENCE)))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // BATCH)
        return ids[i % BATCH], mask[i % BATCH]

    def tokens(self, offset: int, n: int) -> Iterator[np.ndarray]:
        """The ids of [offset, offset + n) as views, batch by batch."""
        step = SEQUENCE * BATCH
        while n > 0:
            flat = self.batch(offset // step)[0].reshape(-1)
            at = offset % step
            take = min(n, step - at)
            yield flat[at:at + take]
            offset, n = offset + take, n - take


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path, end_id)
        part = TaskContext.get().partitionId()
        path, writer = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            offsets, lengths = [], []
            for first in range(0, batch.num_rows, AT_ONCE):
                for ids in encoder.encode(batch.column(1).slice(first, AT_ONCE).to_pylist()):
                    writer = writer or SequenceWriter(path, encoder.dtype)
                    offsets.append(writer.total)
                    lengths.append(len(ids) // encoder.dtype.itemsize)
                    writer.add(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(offsets), pa.int32()), pa.array([path] * len(offsets), pa.string()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["doc_id", "part", "path", "at", "n_tokens"])
        if writer:
            writer.close()
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                 order: tuple[str, ...] = ("doc_id",)) -> tuple[str, DataFrame]:
    """Write the files in ascending ``order`` (ids, if not given); returns the folder and the stored index
    (doc_id, part, path, at, n_tokens, start): ``at`` counts tokens of the file, ``start`` those of all documents before."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    index_path = f"{folder}/index"
    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES) if size < 1 << 60 else 0)   # larger: not known
    keys = [f"__o{i}" for i in range(len(order))]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(k) for c, k in zip(order, keys)])
               .repartitionByRange(files, *keys).sortWithinPartitions(*keys).drop(*keys))
    schema = "doc_id long, part int, path string, at long, n_tokens long"
    ordered.mapInArrow(_writer(folder, tokenizer_path, end_id), schema).write.parquet(index_path)
    index = spark.read.schema(schema).parquet(index_path)
    # one row per file; ranges ascend with the partition number
    files = index.groupBy("part", "path").agg(F.sum("n_tokens").alias("n"))
    before = files.select("path", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return folder, index.join(before, "path").withColumn("start", F.col("before") + F.col("at")).drop("before")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, opened = None, None
    for batch in batches:
        crcs = []
        for p, at, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if p != path:
                path, opened = p, SequenceFile(p)
            crc = 0
            for ids in opened.tokens(at, n):
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(index: DataFrame) -> DataFrame:
    """Per document (doc_id, start, n_tokens, ids_crc32) as read back from the files."""
    by_file = index.select("doc_id", "path", "at", "n_tokens", "start").repartition("path").sortWithinPartitions("path", "at")
    return by_file.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write the token files of ``docs`` and return the digest that reading them gives."""
    return read_digest(write_tokens(docs, tokenizer_path, end_id, order=order)[1])
