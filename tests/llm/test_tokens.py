import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablescout.llm.packing import Encoder, difference, packed, windows_of
from tablescout.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["it's I'll you've 're 's's ''s  's \n 't", "a  b   c\n\nd \t e ", "x<|endoftext|>y <|endoftext|> <|endoftext|>", " ", " \n", "", "'s", "'",
         "é'ré'd 12'3", "日本語 テスト １２３ ½²", "՘֋ a\U00010940\U00010941 😀😀 !", "naïve—“quotes”…", "\u0085z\x1c\x1d y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(tokenizer):
    r = random.Random(2)
    signs = " \n\t'abstrelvmd019.,!é ⅷ日<|> "
    texts = TEXTS + ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    ids, offs = Encoder(PATH).encode(texts)
    for text, a, b in zip(texts, offs[:-1], offs[1:]):
        assert list(ids[a:b]) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_counts(spark, odd, none, tokenizer):
    docs = odd.select("doc_id", "text", "n").union(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n int"))
    want = sorted(str((r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 512))
                  for r in docs.collect())
    assert sorted(str(tuple(r)) for r in token_counts(docs, PATH).collect()) == want
    assert token_counts(none, PATH).count() == 0


def test_packing_is_a_round_trip(spark, odd, none, tokenizer):
    rows = packed(odd, PATH).toPandas()
    assert packed(none, PATH).count() == 0
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    for r in odd.dropDuplicates(["doc_id"]).collect():
        times = sum(x.doc_id == r.doc_id for x in odd.select("doc_id").collect())
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        own = rows[rows.doc_id.isna() if r.doc_id is None else rows.doc_id == r.doc_id]
        assert own.length.sum() == times * len(ids) and set(own.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in own.itertuples())


def test_differencing():
    assert sorted(np.bincount(difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    sizes = np.random.default_rng(1).integers(1, 257, 900)
    window = windows_of(sizes, 1024)
    load = np.bincount(window, sizes)
    assert load.max() <= 1024 and load.sum() >= 0.99 * 1024 * len(load)
    assert len(set(windows_of(np.full(5, 1000), 1024))) == 5


def test_words_are_encoded_without_threads_and_decoded_at_once(monkeypatch):
    from tablescout.llm import pretokens as pt

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    splitter = pt.Splitter(PATH)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    codes, start, end, _, _ = splitter.split(["naïve 日本 😀 it's", " two  words"])
    assert pt.texts_of(codes, start, end) == ["naïve", " 日本", " 😀", " it", "'s", " two", " ", " words"]
    assert pt.texts_of(codes, start[:0], end[:0]) == [] and np.all(end > start)


def test_tasks_hold_little_text_at_once_and_open_the_tokenizer_once(monkeypatch):
    import pyarrow as pa

    from tablescout.llm import pretokens as pt
    from tablescout.llm import token_counts as tc
    from tablescout.llm.texts import KeyTable

    sizes, splitter = [], pt.Splitter(PATH)
    split = splitter.split
    monkeypatch.setattr(splitter, "split", lambda parts: sizes.append(sum(map(len, parts))) or split(parts))
    text = "some plain words " * 1000
    batch = pa.RecordBatch.from_pydict({"row": list(range(60)), "doc_id": list(range(60)), "text": [text] * 60})
    assert sum(b.num_rows for b in tc._vocabulary(lambda: splitter)([batch])) == 5
    head = KeyTable(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
    assert sum(b.num_rows for b in tc._frequencies(lambda: splitter, lambda: head)([batch])) == 60
    assert sum(sizes) == 120 * len(text) and max(sizes) <= 1 << 18
