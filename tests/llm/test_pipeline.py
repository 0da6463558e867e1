"""run() over a small corpus against stages that are computed by brute force, one after the other."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import classes, fingerprint_by_hand, lines_by_brute_force, prose

import corpus_pipeline
from framesift.llm.byte_bpe import encoding
from framesift.llm.common import text_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    base = [prose(rng.randint(15, 60)) for _ in range(120)]
    line = prose(9)
    rows = []
    for i in range(300):
        text = base[i % 120] if i % 3 else prose(30) + f"\n{line}\n" + prose(8)
        if i % 10 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 17 == 0:
            text += ' token = "0123456789abcdef0123456789abcdef01234567"'
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run(spark, folder):
    from framesift.llm.quality_fm import score_texts, train
    from framesift.llm.secret_crf import find_secrets, fitted

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in score_texts(docs, train(docs, labels)).where("predicted = 1").collect()}
    assert {i for i in texts if i % 10} <= good and len(good) < 300
    texts = lines_by_brute_force([(i, t) for i, t in texts.items() if i in good])
    order = sorted(texts)
    roots = classes([fingerprint_by_hand(texts[i]) for i in order], lambda a, b: (a ^ b).bit_count() <= 3)
    texts = {i: texts[i] for n, (i, r) in enumerate(zip(order, roots, strict=True)) if n == r}
    found = find_secrets(*text_bytes(pa.array(list(texts.values()))), fitted())
    sizes, enc = {}, encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for (i, text), spans in zip(texts.items(), found, strict=True):
        out, end = "", 0
        for a, b, _ in spans:
            if a >= end:
                out += text[end:a] + "[SECRET]"
            end = max(end, b)
        sizes[i] = len(enc.encode_ordinary(out + text[end:]))
    got = corpus_pipeline.run(spark, folder).collect()
    total = dict.fromkeys(texts, 0)
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == sizes


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
