"""Words that a polynomial hash cannot tell apart stay apart."""

import numpy as np
import pytest

from sparkloom.llm import jaccard_join, langid, maxent_lm


def pair(n, a="a", b="b"):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("doublings", [10, 11, 12])
def test_names_of_mirrored_words(doublings):
    x, y = pair(doublings)
    w = langid.Words([x, y])
    for h in (jaccard_join.shingles([x.encode(), y.encode()])[1], maxent_lm.tokens([x.encode(), y.encode()])[0][::2], w.hashes(w.start, w.end, 0)):
        assert len(set(h.tolist())) == 2


def test_names_depend_on_all_bytes_and_on_nothing_else():
    rng = np.random.default_rng(1)
    words = {bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*range(40), 255, 256, 257, 5000] for _ in range(30)}
    line = b" ".join(words) + b" "
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    h = jaccard_join.names(np.frombuffer(line, np.uint8), starts, ends, 3)
    assert len(set(h.tolist())) == len(words)
    for w, name in zip(words, h):
        assert jaccard_join.names(np.frombuffer(b"zz" + w + b"yyyyyyyyyy", np.uint8), np.array([2]), np.array([2 + len(w)]), 3)[0] == name


def test_texts_of_mirrored_words_are_not_linked(spark):
    x, y = pair(10)
    rows = [(1, x), (2, y), (3, x.upper()), (4, f"{x} b c d e f"), (5, f"{y} b c d e f")]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rows_without_a_key_are_sampled_as_others(spark):
    rows = [(None, f"the word number {k} is here" if k % 2 else f"le mot nombre {k} est ici", "en" if k % 2 else "fr") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.train(df, sample_rows=400)
    whole = langid.train(df)
    assert few.langs == whole.langs == ["en", "fr"]
    said = [r["language"]["lang"] for r in langid.predict(df.limit(200), few).select("language").collect()]
    assert len(set(said)) == 2
