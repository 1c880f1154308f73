import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_decontaminate import plain_hits
from test_minhash import brute_classes
from test_pii import by_regex
from tokenizers import Tokenizer

from loam.llm import pii, quality_rules


def test_pipeline_equals_plain_stages(spark, sf_dir):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge_quality(source).filter("kept").collect()}
    docs = {r.doc_id: r.text for r in source.collect() if r.doc_id in kept}
    classes = brute_classes(list(docs.items()))
    docs = {i: t for i, t in docs.items() if classes[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {i: t for i, t in docs.items() if not plain_hits(t, items)[1]}
    docs = {i: pii.masked(t, [(a, b, pii.KINDS[k].upper()) for a, k, b in by_regex(t)]) for i, t in docs.items()}
    rows = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        rows[r.doc_id].append(r)
    assert rows.keys() == docs.keys() and 50 < len(docs) < source.count()
    own, same = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i, text in docs.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(rows[i], key=lambda r: r.piece)
        same += [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces] and sum(p.length for p in pieces) == len(ids)
    assert same >= len(docs) - 3  # disclosing terms may be masked as well


def test_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain words. " * 40, "en", "s", 5, 1), (2, None, None, None, None, 2), (2, "", "en", "s", 0, 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
