"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of Arrow IPC files, one for each range of document ids: record batches
of ``sequences_per_batch`` rows, each row a fixed-size list of ids and one of mask bits (1: a
token, 0: padding). A file's last batch carries the padding. Batches are found by the file's
footer and their buffers are mapped, so any sequence is read without copying or decoding what
stands before it. A second Arrow file beside each holds its documents' starts and lengths.

Files are written by tasks that range-partition the documents; names derive from the
partition and files appear by rename, so a repeated task replaces its own files.

Edge cases: null is the empty text (its only id is the end id); repeated ids keep a row each, in
an order fixed by their texts; null ids come first; no rows: no files; texts are read whole; a special
token's literal in a text is that token, as the library has it; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.bpe import _LATIN, _LETTER
from dumploom.llm.common import arrow_map, bound_batches, scratch_path

CACHE = 500_000  # encoded words a worker remembers
BLOCK = 1 << 20  # longer texts go to the library as they are
#: How the library cuts lower-cased texts of ``_LATIN`` characters into words.
WORDS = re.compile(f"[{_LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTER}0-9]+")


@dataclass(frozen=True)
class FileFormat:
    sequence_length: int = 2048
    sequences_per_batch: int = 64
    #: Text bytes a file should hold; sets the number of range partitions.
    bytes_per_file: int = 48 << 20

    def schema(self, width: pa.DataType) -> pa.Schema:
        return pa.schema([("ids", pa.list_(width, self.sequence_length)), ("mask", pa.list_(pa.bool_(), self.sequence_length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class WordTokenizer:
    """A library tokenizer that lower-cases, cuts by ``WORDS`` and marks each word's last token with </w>.

    Words of plain texts are encoded by the library once, many at a time, and told apart again
    by their last tokens; a text with other characters, or with the literal of a special or added
    token, is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Texts that hold an added token's literal, in whatever case, are the library's to read.
        added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab()
        self.width = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_all([text])))

    def encode_all(self, texts: list[str]):
        """The ids of each text, the fresh words of about a million characters being learned together."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        group, size = [], 0
        for text in texts:
            lower = text.lower()
            plain = len(text) <= BLOCK and _LATIN.fullmatch(text) and not (self.added and self.added.search(lower))
            group.append(WORDS.findall(lower) if plain else text)
            size += len(text)
            if size > BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list):
        cache = self.cache
        self.learn(list({w for words in group if isinstance(words, list) for w in words if w not in cache}))
        for words in group:
            whole = isinstance(words, str)
            yield np.array(self._whole(words), self.width).tobytes() if whole else b"".join(map(cache.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self._whole(" ".join(part)), self.width)
            ends = np.flatnonzero(self.last[ids]) + 1
            for word, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.cache[word] = ids[a:b].tobytes()

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path on it."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes full batches; holds one batch at most."""

    def __init__(self, sink, form: FileFormat, width):
        self.form, self.width, self.kind = form, width, pa.from_numpy_dtype(width)
        self.out = pa.ipc.new_file(sink, form.schema(self.kind))
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.form.sequence_length * self.form.sequences_per_batch * np.dtype(self.width).itemsize
        if self.size >= full:
            data = b"".join(self.held)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._batch(np.frombuffer(data, self.width, full // np.dtype(self.width).itemsize, at))
            self.held, self.size = [data[whole:]], len(data) - whole

    def _batch(self, ids: np.ndarray) -> None:
        n = self.form.sequence_length
        padded = np.zeros(-(-len(ids) // n) * n, self.width)
        padded[: len(ids)] = ids
        lists = pa.FixedSizeListArray.from_arrays
        mask = pa.array(np.arange(len(padded)) < len(ids))
        self.out.write_batch(pa.record_batch([lists(pa.array(padded), n), lists(mask, n)], schema=self.out_schema()))

    def out_schema(self) -> pa.Schema:
        return self.form.schema(self.kind)

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.width)
        if len(rest):
            self._batch(rest)
        self.out.close()


class SequenceReader:
    """Random access to sequences and to runs of ids; a local file is mapped into memory."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._held = (-1, None)

    def _ids(self, batch: int) -> np.ndarray:
        if self._held[0] != batch:
            self._held = (batch, self.file.get_batch(batch).column("ids").values.to_numpy())
        return self._held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """The ids, without a copy, and the mask of sequence ``k``."""
        batch, row = divmod(k, self.per_batch)
        mask = self.file.get_batch(batch).column("mask")
        return self._ids(batch)[row * self.length : (row + 1) * self.length], mask[row].values

    def parts(self, start: int, n: int):
        """The ids from ``start`` on, batch by batch."""
        size = self.per_batch * self.length
        while n > 0:
            batch, at = divmod(start, size)
            got = self._ids(batch)[at : at + n]
            yield got
            start, n = start + len(got), n - len(got)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, form: FileFormat = FileFormat()) -> list[dict]:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns a row a file, in order: file, n_docs, n_tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // form.bytes_per_file))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        from pyspark import TaskContext

        words, (store, path) = tokenizer(tokenizer_path), file_system(folder)
        number, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, end = f"part-{number:06d}", np.array([end_id], words.width).tobytes()
        data, index, n_docs, at = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/.{name}-{mark}.ids")
                index_sink = store.open_output_stream(f"{path}/.{name}-{mark}.docs")
                data, index = SequenceWriter(sink, form, words.width), pa.ipc.new_file(index_sink, INDEX)
            starts, sizes = [], []
            for got in words.encode_all(batch.column("text").to_pylist()):
                ids = got + end
                data.add(ids)
                starts.append(at)
                sizes.append(len(ids) // np.dtype(words.width).itemsize)
                at += sizes[-1]
            n_docs += batch.num_rows
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        if data is None:
            return
        for writer, opened in ((data, sink), (index, index_sink)):
            writer.close()
            opened.close()
        for kind in ("ids", "docs"):
            store.move(f"{path}/.{name}-{mark}.{kind}", f"{path}/{name}.arrow" if kind == "ids" else f"{path}/{name}.docs.arrow")
        yield {"part": [number], "file": [name], "n_docs": [n_docs], "n_tokens": [at]}

    bound_batches(docs.sparkSession)
    written = arrow_map(ordered, write, "part long, file string, n_docs long, n_tokens long").collect()  # a row a file
    return [r.asDict() for r in sorted(written, key=lambda r: r.part)]


def read_files(spark, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    before, rows = 0, []
    for f in files:
        rows.append((f["file"], before))
        before += f["n_tokens"]
    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))

    def read(batches):
        store, path = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                local = isinstance(store, fs.LocalFileSystem)
                source = pa.memory_map(f"{path}/{name}.arrow") if local else store.open_input_file(f"{path}/{name}.arrow")
                reader = SequenceReader(source)
                index = pa.ipc.open_file(store.open_input_file(f"{path}/{name}.docs.arrow"))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in reader.parts(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = docs.column("start").to_numpy() + first
                    yield {"doc_id": docs.column("doc_id"), "start": starts, "n_tokens": docs.column("n_tokens"), "ids_crc32": crcs}

    return arrow_map(listed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    return read_files(spark, folder, write_files(docs, folder, P.path("word_bpe_49k.json")))
