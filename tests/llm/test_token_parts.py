"""Token ids and the texts they give back are handed on in parts."""

from __future__ import annotations

from sparkloom.llm import bpe
from sparkloom.llm.queries import tokenizer_path


def test_token_ids_are_handed_on_some_texts_at_a_time(spark):
    spec = bpe.Spec(spark, tokenizer_path())
    rows = [(k, None if k == 7 else f"Text {k} of some words, é.") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = bpe.decode(bpe.encode(df, spec), spec)
    out = bpe.round_trip(df, spec)
    assert out.columns == plain.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    assert "MapInArrow" in out._jdf.queryExecution().toString()
