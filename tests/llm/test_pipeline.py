import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillframe.llm import language, quality
from test_text_ops import brute_classes, without_repeats


def test_stages_on_the_small_table(spark, sf, table):
    """Each stage against what its predecessor kept, the deterministic ones by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert set(kept["quality rules"]) == good
    known = docs.join(spark.createDataFrame([(i,) for i in good], "doc_id long"), "doc_id")
    found = {r.doc_id for r in language.predict(known, language.fit(known.filter(language.training_row()))).filter("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert len(set(kept["language ID"]) ^ found) <= 1
    rows = sorted(kept["language ID"].items())
    assert set(kept["near-duplicates"]) == {rows[k][0] for k in brute_classes(rows)}
    expected = {i: (" ".join(text.split()), k) for i, n, k, text in without_repeats(sorted(kept["near-duplicates"].items())) if k < n}
    assert set(kept["substring dedup"]) == set(expected)
    for i, text in kept["substring dedup"].items():
        assert text == (expected[i][0] if expected[i][1] else kept["near-duplicates"][i])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["substring dedup"].items()}
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in lengths} == lengths
    assert len({r.sequence_id for r in packed}) <= -(-sum(lengths.values()) // 2048) + 2


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert np.isin([r.length for r in rows.collect()], np.arange(1, 2049)).all()


def test_edges(spark, docs, no_docs, sf):
    for table in (docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf).cache()
            assert now.columns == table.columns, name
        left = {r.doc_id for r in now.collect()}
        assert left <= {1, 2, 7, 8, None}
        corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
