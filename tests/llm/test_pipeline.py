"""The pipeline against plain versions of its stages, and the registration."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from critiq.llm.byte_bpe import read_ranks
from critiq.llm.pii import entities, replace

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    from test_minhash_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    kept = stages["toxicity"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() <= docs.count()
    rows = {r.doc_id: r.text for r in kept.collect()}
    single = stages["minhash_near_dedup"](spark, kept, SF).cache()
    groups = brute(list(rows.items()), 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if c == i}
    clean = stages["decontamination"](spark, single, SF).cache()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {r.doc_id for r in single.collect() if any(" ".join(t.split()) in " ".join(r.text.split()) for t in items)}
    safe = stages["pii"](spark, clean, SF).cache()
    assert safe.columns == docs.columns and safe.dtypes == docs.dtypes
    secret = hashlib.sha256(corpus_pipeline.KEY.encode()).digest()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {i: (n := replace(t, secret)[0], len(n)) for i, t in texts.items()}
    assert any(entities(t) for t in texts.values())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r for r in stages["byte_bpe"](spark, safe, SF).collect()}
    for r in safe.collect():
        ids = library.encode_ordinary(r.text)
        assert out[r.doc_id].n_tokens == len(ids) and out[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, out.values()))


def test_odd_documents_pass_all_stages(spark, tmp_out):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "no id at all", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == (5 if name == "toxicity" else 4), name  # one of the two rows (3, "a") stays
        docs.limit(0).write.parquet(f"{tmp_out}/{name}")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_without_an_id_of_their_own(spark):
    long = " ".join(f"word{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(7, long), (5, long + " end"), (None, long), (None, long + " x"), (8, "only here"), (8, long), (9, "twice"), (9, "twice"), (9, "other text of nine"), (None, None), (None, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(5, long + " end"), (8, "only here"), (9, "twice"), (9, "other text of nine"), (None, None), (None, None), (None, " "), (None, " ")], key=str)
    tainted = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(None, item), (None, "clean"), (4, item), (4, "clean"), (6, "clean"), (None, None)]], COLUMNS)
    clean = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, tainted, SF).collect()), key=str)
    assert clean == sorted([(None, "clean"), (4, "clean"), (6, "clean"), (None, None)], key=str)


def test_clashing_names(spark):
    extra = ["toxicity_score", "PII", "key", "odd_id", "n", "kept", "id", "c1", "ids", "row", "a.b"]
    rows = [(1, "write to jane.roe@example.com now", "en", "s", 33), (1, "write to jane.roe@example.com now", "en", "s", 33), (2, None, "en", "s", None)]
    docs = spark.createDataFrame([(*r, *[f"own {c}" for c in extra]) for r in rows], COLUMNS + "".join(f", `{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*"doc_id text lang source n_chars".split(), *extra], name
        got = docs.collect()
        assert len(got) == (3 if name == "toxicity" else 2) and all(r[c] == f"own {c}" for r in got for c in extra), name
    assert "jane" not in next(r.text for r in got if r.doc_id == 1)
    assert corpus_pipeline.byte_bpe(spark, docs, SF).count() == 2


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
