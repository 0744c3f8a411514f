"""Ids beyond 2^53 beside nulls, only-null ids, and clashing column names in the training operators and stages."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runlens.llm import stages
from runlens.llm.mixing import mix
from runlens.llm.nn_descent import near_classes
from runlens.llm.pieces import encode_decode
from runlens.llm.suffix_dedup import remove_repeats
from runlens.llm.token_counts import count_tokens

BIG = 2 ** 53 + 1


@pytest.mark.parametrize("ids", [(BIG, None, 7), (None, None, None)])
def test_ids_come_back_as_they_went_in(spark, ids):
    texts = ["one text", "x" * 70_000, "another text"]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    want = sorted(ids, key=str)
    for out in (count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")), remove_repeats(df, outputs=()),
                encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids_sha256",))):
        assert out.schema["doc_id"].dataType.simpleString() == "bigint"
        assert sorted((r.doc_id for r in out.collect()), key=str) == want


def test_vectors_without_ids(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.0, 1.0]]
    df = spark.createDataFrame([(None, v[0], 1), (BIG, v[1], 1), (None, v[2], 1), (None, v[3], 1), (None, None, 1)],
                               "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_classes(df).collect()), key=str)
    assert got == sorted([(None, 1, BIG), (BIG, 1, BIG), (None, 1, None), (None, 1, None), (None, 0, None)], key=str)


def test_mix_and_near_duplicates_with_clashing_names(spark):
    names = ["_prob", "_id", "_whole", "_order", "_source", "_blocks", "_row", "_of", "__row", "__row_", "least", "component_id"]
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    df = spark.createDataFrame([(i if i % 3 else None, words[i % 30], "s%d" % (i % 2)) for i in range(40)],
                               "doc_id long, text string, source string")
    for k, c in enumerate(names):
        df = df.withColumn(c, F.lit(k))
    out = mix(df, F.lit(5))
    assert out.count() == 40 and all(r[c] == k for r in out.collect() for k, c in enumerate(names))
    kept = stages.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and kept.count() == 30
    assert all(r[c] == k for r in kept.collect() for k, c in enumerate(names))
