"""Token-ID files: independent zstandard frames with a trailing seek table.

File, in order:

* a zstandard frame for each document, in ascending order of document id, holding its token ids (with the
  end id) as little-endian unsigned 32-bit integers, and zstandard's own content checksum;
* the seek table, inside a skippable frame (magic 0x184D2A5E, so plain zstandard readers pass over it): for
  each document an ``ENTRY`` with its id, the offset and length of its frame, its number of ids and the
  crc32 of the uncompressed frame;
* inside the same frame, last, ``TAIL``: number of entries, crc32 of the entries, and the marker ``TOKSEEK1``.

A reader fetches the tail, then the entries, then only the frames of the documents it wants, and checks
each against its crc32. A task writes one file under a name of its own attempt and moves it into place, so
that a task that runs again replaces its file by an equal one.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.byte_bpe import CACHED_CHARS, slices
from critiq.llm.common import cut

ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8"), ("crc", "<u4")])
TAIL = struct.Struct("<QI8s")
MARK = b"TOKSEEK1"
SKIPPABLE = 0x184D2A5E
END_ID = 0
CACHE = 900_000  # slices whose ids a process remembers
PORTION = 1 << 20  # characters encoded, or bytes of ids returned, at once


def _filesystem(folder: str):
    """(file system, path) of a URI or local path, as pyarrow knows it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else Path(folder).absolute().as_uri())


class Writer:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.at, self.entries = out, 0, []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.pack(ids)
        self.out.write(frame)
        self.entries.append((doc_id, self.at, len(frame), len(ids) // 4, zlib.crc32(ids)))
        self.at += len(frame)

    def close(self) -> None:
        table = np.array(self.entries, ENTRY).tobytes()
        tail = TAIL.pack(len(self.entries), zlib.crc32(table), MARK)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(tail)) + table + tail)


class Reader:
    """Documents of one open file (pyarrow random access file or any seekable one)."""

    def __init__(self, source):
        import zstandard

        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - TAIL.size)
        n, crc, mark = TAIL.unpack(source.read(TAIL.size))
        if mark != MARK:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - TAIL.size - n * ENTRY.itemsize)
        table = source.read(n * ENTRY.itemsize)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(table, ENTRY)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        """Ids of the file's k-th document; only its frame is read and decompressed."""
        e = self.entries[k]
        self.source.seek(int(e["offset"]))
        ids = self.unpack(self.source.read(int(e["length"])))
        if zlib.crc32(ids) != e["crc"] or len(ids) != 4 * e["tokens"]:
            raise ValueError(f"the frame of document {e['id']} is damaged")
        return ids

    def documents(self, ids: list[int]) -> dict[int, list[np.ndarray]]:
        """Token ids of the wanted documents; several arrays where the file has an id more than once."""
        first, last = np.searchsorted(self.entries["id"], ids), np.searchsorted(self.entries["id"], ids, side="right")
        return {i: [np.frombuffer(self.frame(k), "<u4") for k in range(a, b)] for i, a, b in zip(ids, first.tolist(), last.tolist()) if a < b}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers; for a few ids an array of the standard library is quicker than numpy's."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of whole texts, the end id included, by the tokenizers library.

    A byte-level BPE definition with the common pattern, without a normaliser and with special added tokens
    only, encodes the pattern's slices apart from each other; there each distinct slice goes through
    the library once, and a process remembers CACHE short ones at most. Other definitions encode text by text.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        rules = json.loads(definition)
        split = rules.get("pre_tokenizer") or {}
        self.by_slice = not rules.get("normalizer") and all(t["special"] for t in rules.get("added_tokens", [])) and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        end = END_ID.to_bytes(4, "little")
        if not self.by_slice:
            return [ids + end for ids in self._ids(texts)]
        parts = list(slices(texts))
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known))
        for at in range(0, len(new), 4096):
            self.known.update(zip(new[at : at + 4096], self._ids(new[at : at + 4096])))
        out = [b"".join([*map(self.known.__getitem__, p), end]) for p in parts]
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.known[p]
        return out


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """One for each process, so that a reused worker keeps what it knows from task to task."""
    return Encoder(definition)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode all texts and write the files; (file, first_id, last_id, documents, tokens) of each file.

    Documents are dealt to files by ranges of their id (ties by a hash of the text), so the files in
    order of their names hold all documents in ascending order. Null texts count as empty: the end id
    alone. Rows that repeat an id are all written. Rows without an id are left out: the format finds
    documents by it. An empty table writes no file. folder: a path or URI that all executors share.
    tokenizer_path: a definition of the tokenizers library, read by the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    system, path = _filesystem(folder)
    system.create_dir(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, out = None, None, None
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, path = _filesystem(folder)
        name, own = f"{path}/part-{part:06d}.tok.zst", f"{path}/.part-{part:06d}.{attempt}.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode, out = _encoder(definition.value), system.open_output_stream(own)
                writer = Writer(out)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                upto, portion, size = at, [], 0
                while upto < len(ids) and (not portion or size < PORTION):
                    portion.append(texts[upto].as_py() or "")
                    size += len(portion[-1])
                    upto += 1
                for k, encoded in enumerate(encode(portion)):
                    writer.add(ids[at + k], encoded)
                at = upto
        if writer is not None:
            writer.close()
            out.close()
            system.move(own, name)
            e = np.array(writer.entries, ENTRY)
            yield pa.RecordBatch.from_pydict({"file": [f"part-{part:06d}.tok.zst"], "first_id": [int(e["id"][0])], "last_id": [int(e["id"][-1])], "documents": [len(e)], "tokens": [int(e["tokens"].sum())]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    order = ["id", F.xxhash64("text")]
    dealt = texts.repartitionByRange(files, *order) if files else texts.repartitionByRange(*order)
    return cut(dealt.sortWithinPartitions(*order).mapInArrow(rows, "file string, first_id long, last_id long, documents long, tokens long"))


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of every document of the files that ``manifest`` lists.

    start: ids of all documents before it; ids: little-endian unsigned 32-bit, the end id included.
    Every frame is checked against its crc32. An empty manifest gives an empty result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{file}") as source:
                    reader = Reader(source)
                    entries = reader.entries
                    starts = start + np.cumsum(entries["tokens"].astype(np.int64)) - entries["tokens"].astype(np.int64)
                    upto = 0
                    while upto < len(entries):
                        at, ids, size = upto, [], 0
                        while upto < len(entries) and (not ids or size < 4 * PORTION):
                            ids.append(reader.frame(upto))
                            size += len(ids[-1])
                            upto += 1
                        part = entries[at:upto]
                        yield pa.RecordBatch.from_arrays([pa.array(part["id"].astype(np.int64)), pa.array(starts[at:upto]), pa.array(part["tokens"].astype(np.int64)), pa.array(ids, pa.binary())], [id_col, "start", "n_tokens", "ids"])

    files = int(manifest.count())
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    listed = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    return listed.repartition(max(1, files)).mapInArrow(rows, f"`{id_col}` long, start long, n_tokens long, ids binary")
