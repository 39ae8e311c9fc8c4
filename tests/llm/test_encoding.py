import os
import random

import pytest

from corpuswerk.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary")


def texts():
    rng = random.Random(2)
    own = ["", "a", " ", "  \n ", "Hallo Welt", "x  y", " \t a\n\n  b ", "don't  stop", "Über-größe 12345 👍🏽!", "<|endoftext|> x", "é é", "a b", "wort " * 20000, "x" * 3000]
    return own + ["".join(rng.choice("ab \n\t.,'1ä ") for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_ids_equal_those_of_the_whole_text_and_decode_to_it(spark, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK_ROWS", 20)
    monkeypatch.setattr(encoding, "WORD_BLOCKS", 3)
    rows = [(k, t, "s", 1) for k, t in enumerate(texts())] + [(None, "ohne", "s", 1), (None, None, None, 1), (7, "zweimal", "s", 1), (7, "zweimal", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, block int")
    whole = encoding._encoder(encoding.VOCABULARY)
    got = encoding.encode(docs, keep=("source",)).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if k is None else k, whole.encode_ordinary(t or ""), s or "") for k, t, s, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, r.source or "") for r in got) == want
    counted = encoding.count_tokens(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in counted) == sorted((k, len(i)) for k, i, _ in want)
    back = encoding.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got] + [(9999, None)], "doc_id bigint, ids array<int>")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in back) == sorted([(-1 if k is None else k, t or "") for k, t, _, _ in rows] + [(9999, "")])
    assert [r.text for r in back if r.doc_id == 9999] == [None]
    assert encoding.encode(docs.limit(0)).count() == 0
