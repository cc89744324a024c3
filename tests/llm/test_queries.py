"""The registered queries over whole tables: against their SQL, or against the tokenizer libraries."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from critiq.llm.byte_bpe import read_ranks
from critiq.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(want.fetchall(), columns) == plain(got.collect(), got.columns)


def test_tokens_equal_the_libraries(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {d["doc_id"]: library.encode_ordinary(d["text"] or "") for d in docs}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {d["doc_id"]: (len(ids[d["doc_id"]]), digest(np.array(ids[d["doc_id"]], "<u4").tobytes()), digest((d["text"] or "").encode())) for d in docs}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_byte_bpe"](spark, SF).collect()} == want
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for d in docs:
        own = [*other.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        want[d["doc_id"]] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, SF).collect()} == want


def test_rows_of_the_others(spark):
    docs = pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert QUERIES["op8_pii"](spark, SF).select("doc_id").distinct().count() == docs
    turns = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    got = QUERIES["op9_quote_links"](spark, SF).collect()
    assert len(got) == len({(t["conv_id"], t["turn"]) for t in turns})
    # these conversations hold no quotes: every message replies to the turn before
    assert all(r.n_quotes == 0 and r.place == r.turn and r.reply_to == (r.turn - 1 if r.turn else None) for r in got)
