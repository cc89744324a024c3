"""Token files: exact round trip, seeks, damage."""

import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from critiq.llm.token_files import ENTRY, Reader, Writer, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_format_reads_only_the_frames_asked_for():
    out = io.BytesIO()
    writer = Writer(out)
    docs = {i: np.arange(i * 10, dtype="<u4").tobytes() + b"\0\0\0\0" for i in (2, 3, 5, 9)}
    for i, data in docs.items():
        writer.add(i, data)
    writer.add(9, b"\0\0\0\0")
    writer.close()
    reads = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    reader = Reader(Counted(out.getvalue()))
    reads.clear()
    got = reader.documents([3, 4, 9])
    assert {i: [x.tobytes() for x in v] for i, v in got.items()} == {3: [docs[3]], 9: [docs[9], b"\0\0\0\0"]}
    assert reads == [int(reader.entries["length"][k]) for k in (1, 3, 4)]
    # any zstandard reader passes over the seek table
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join([*docs.values(), b"\0\0\0\0"])


def test_damage_is_found():
    out = io.BytesIO()
    writer = Writer(out)
    writer.add(1, b"\1\0\0\0" * 100)
    writer.close()
    data = bytearray(out.getvalue())
    data[-20 - ENTRY.itemsize // 2] ^= 1
    with pytest.raises(ValueError):
        Reader(io.BytesIO(bytes(data)))
    with pytest.raises(ValueError):
        Reader(io.BytesIO(out.getvalue()[:-1]))


def test_round_trip(spark, tmp_out):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = [(k * 3 % 101, f"Text {k}, it's <|endoftext|> number {k}.\n\n" * (k % 7)) for k in range(60)] + [(500, None), (501, ""), (7, "seven again"), (9999, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts] + [(None, "left out", "x")], "doc_id long, text string, start string")
    folder = f"{tmp_out}/token files"
    got = read_token_files(write_token_files(docs, folder, PATH, files=5), folder).collect()
    assert len([f for f in os.listdir(folder) if f.endswith(".tok.zst")]) >= 2 and not [f for f in os.listdir(folder) if f.startswith(".part")]
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in texts)
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in texts)
    assert sorted((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    empty = write_token_files(docs.limit(0), f"{tmp_out}/none", PATH)
    assert read_token_files(empty, f"{tmp_out}/none").count() == 0
