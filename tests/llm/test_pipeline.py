"""The registered queries' columns, and the pipeline stage by stage against plain versions."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from ratelens.llm import queries
from ratelens.llm.common import written

COLUMNS = {
    "op1_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op2_benchmark_decontamination": ["doc_id", "item_id", "score", "first_word", "n_words", "passage"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op8_secret_scan": ["doc_id", "start", "n_chars", "score", "secret"],
    "op9_substring_dedup": ["doc_id", "first_word", "n_words", "same_as", "exact"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op11_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_every_operator_is_registered():
    import __spark_entry__
    assert set(queries.LLM_QUERIES) == set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontaminate", "mix", "tokens"]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_its_columns(spark, name):
    out = queries.LLM_QUERIES[name](spark, brute.SF_SMALL)
    assert out.columns == COLUMNS[name] and out.count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{brute.SF_SMALL}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], brute.SF_SMALL), f"test-{name}"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    texts = [{r[0]: r[1] for r in x} for x in rows[:4]]
    # quality: labelled good documents stay, most labelled bad ones go
    good = [i for i, y in labels.items() if y == 1 and i in texts[0]]
    bad = [i for i, y in labels.items() if y == 0 and i in texts[0]]
    assert np.mean([i in texts[1] for i in good]) > 0.95 and np.mean([i in texts[1] for i in bad]) < 0.4
    # near duplicates: the least id of each group
    groups = brute.jaccard_components(sorted(texts[1].items()))
    assert set(texts[2]) == {i for i, _, root in groups if i == root}
    # decontamination: documents with a whole item go, documents without any shared 3 words stay
    items = [brute.words(r.text) for r in spark.read.parquet(f"{brute.SF_SMALL}/benchmark.parquet").collect()]
    for i, t in texts[2].items():
        w = brute.words(t)
        whole = any(it == w[k:k + len(it)] for it in items for k in range(len(w) - len(it) + 1) if w[k] == it[0])
        assert not (whole and i in texts[3])
    assert len(texts[3]) > 0.8 * len(texts[2])
    # mix: 0 to 2 whole copies of a row, about 150 % of the words
    copies = {}
    for r in rows[4]:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 2
    taken, there = (sum(len(brute.words(r[1])) for r in x) for x in (rows[4], rows[3]))
    assert abs(taken / there - 1.5) < 0.15
    # tokens: the files hold the rows in order
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    own = sorted((r[0], r[1]) for r in rows[4])
    out = sorted(rows[5], key=lambda r: r[1])
    assert [r[0] for r in out] == [i for i, _ in own]
    for r, (_, t) in zip(out, own):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert r[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline_of_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z", "en", None, 5), (3, "w " * 3000, "en", "a", 6000),
            (3, "w " * 3000, "en", "a", 6000)]
    for name, frame in (("documents", spark.createDataFrame(rows, schema)),
                        ("labels", spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")),
                        ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert all(r.n_tokens >= 1 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_tasks_give_arrow_memory_back_between_batches(monkeypatch):
    import pyarrow as pa
    from ratelens.llm import ngram_jaccard, text
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(1)

    monkeypatch.setattr(text.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["a b c d e f g"])], ["id", "text"]) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in text.returned(iter(batches))] == [0, 1, 2] and len(freed) == 3
    freed.clear()
    assert sum(b.num_rows for b in ngram_jaccard._classes(5, 0.8)(iter(batches))) == 3 and len(freed) == 3
