import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow.fs import FileSystem
from tokenizers import Tokenizer

from tablescout.llm import token_files
from tablescout.llm.simple8b import pack, unpack
from tablescout.llm.token_files import LISTING, TokenFile, WordEncoder, read_ids, windows, write_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = " \n\t'abstrelvmdABΣß019.,!éÀİıſ́ ⅷ日<|>\x0b\x1c\u0085　"


def test_coding_is_a_round_trip():
    r = np.random.default_rng(0)
    for t in range(400):
        sizes = r.integers(0, 200, r.integers(0, 12))
        n = int(sizes.sum())
        values = (r.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1) >> r.integers(0, 64, n).astype(np.uint64)
        if t % 3 == 0:
            values >>= np.uint64(40)
        coded, words, extra = pack(values, sizes)
        assert (unpack(coded, words, extra, sizes) == values).all()
        assert t % 3 or not extra.any()
    assert len(pack(np.ones(120), np.array([120]))[0]) == 2  # sixty one-bit numbers a word


def test_ids_equal_the_library(monkeypatch):
    tokenizer, encoder, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(1)
    texts = ["", " ", "it's I'll", "J̌a. H̱B, İ. İ; ǰ AB. Ab! aB? a.̈ 'S. X's, 1. é. a;b a...", "ΑΣ ΑΣ, x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "é é é ́ x", "x" * 5000]
    texts += ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    ids, size = encoder.encode([t.encode() for t in texts])
    stop = np.cumsum(size)
    for text, a, b in zip(texts, stop - size, stop):
        assert list(ids[a:b]) == tokenizer.encode(text, add_special_tokens=False).ids, text
    with pytest.raises(ValueError):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"Aa{i % 90}B. c" for i in range(400)]
    for name in ("KEPT", "AT_ONCE"):
        monkeypatch.setattr(token_files, name, 50)
    for part in (texts[:100], texts[100:], texts):
        ids, size = encoder.encode([t.encode() for t in part])
        assert ids.tolist() == sum((tokenizer.encode(t, add_special_tokens=False).ids for t in part), [])
    text = b"ab  c\n" * 20 + b"x" * 100 + b" y"
    assert b"".join(windows(text, 7)) == text and sum((p.split() for p in windows(text, 7)), []) == text.split()


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


@pytest.mark.parametrize("file_bytes", [300, 1 << 26])
def test_files(spark, odd, none, tmp_path, file_bytes):
    r = random.Random(2)
    docs = odd.select("doc_id", "text", "n").union(spark.createDataFrame(
        [(r.randint(-50, 50) * 1000, "".join(r.choice(SIGNS) for _ in range(r.randint(0, 200))), 0) for _ in range(40)], "doc_id long, text string, n int"))
    docs = docs.unionByName(spark.createDataFrame([(77, "a b", 0)] * 300 + [(None, f"c {i}", 0) for i in range(300)], "doc_id long, text string, n int"))
    write_ids(docs, PATH, f"file://{tmp_path}/ids", file_bytes=file_bytes)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(str((x.doc_id, (ids := tokenizer.encode(x.text or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())))
                  for x in docs.collect())
    whole = read_ids(spark, f"file://{tmp_path}/ids", ids=True).collect()
    short = read_ids(spark, f"file://{tmp_path}/ids").collect()
    crc = {x.start: x.ids_crc32 for x in short}
    assert sorted(str((x.doc_id, x.ids, crc[x.start])) for x in whole) == want
    whole.sort(key=lambda x: x.start)
    assert [x.doc_id for x in whole] == sorted((x.doc_id for x in whole), key=key)
    assert [x.start for x in whole] == np.cumsum([0] + [x.n_tokens for x in whole])[:-1].tolist()
    write_ids(none, PATH, f"file://{tmp_path}/none")
    assert read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_one_document_from_its_blocks(spark, odd, tmp_path):
    write_ids(odd, PATH, f"file://{tmp_path}/ids")
    system, folder = FileSystem.from_uri(f"file://{tmp_path}/ids")
    name, = set(os.listdir(folder)) - {LISTING} - {x for x in os.listdir(folder) if x.startswith(".")}
    with system.open_input_file(f"{folder}/{name}") as source:
        file = TokenFile(source)
        at = file.doc.tolist().index(7)
        text = odd.filter("doc_id = 7").first().text
        assert file.document(at).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [2]
        assert len(file.offset) == len(file.block) + 1 > 20
        assert sum(map(len, file.steps())) == file.size.sum()


def test_a_word_is_looked_up_once_a_piece(monkeypatch):
    from tablescout.llm import token_files

    asked = []
    of = token_files.Numbers.of
    monkeypatch.setattr(token_files.Numbers, "of", lambda self, things: (asked.extend(things), of(self, things))[1])
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " one two\x0bone\x1c ", "Two\tone \n" * 400, "é\xa0two one", "two"]
    ids, size = encoder.encode([t.encode() for t in texts])
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and size.tolist() == [len(x) for x in want]
    assert len(asked) == len(set(asked)) == 4
