import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablescout.llm import alignment
from tablescout.llm.pretokens import byte_signs
from tablescout.llm.csr import ones, product_blocks, transposed
from tablescout.session import cut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = " \n\t'abstrelvmdß019.,!éÀſ ⅷ日<|> \r▁😀　​"
TEXTS = ["it's I'll you've  's \n 't", "a  b   c\n\nd \t e ", "x<|endoftext|>y <s> </s>", " ", "  ", " \n", "\n", "", "a ", "a  ", " a", "▁", "日本語 テスト", "naïve—“quotes”…",
         "line one.\n  line two\n\n\tline three \n", "<0x41> <unk>", "x" * 3000, "\u0085z\x1c\x1d y \x00 z"]


def brute(rows):
    """Rows of the contract, by comparing all byte ranges."""
    ta, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    signs = {sign: b for b, sign in byte_signs().items()}
    out, links_of = [], []
    for doc_id, text in rows:
        text = text or ""
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        bytes_a = [bytes(signs[c] for c in ta.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
            a, b, bytes_a, bytes_b = [], [], [], []
        ea, eb = np.cumsum([0, *map(len, bytes_a)]).tolist(), np.cumsum([0, *map(len, bytes_b)]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]]
        ends = sorted(set(ea[1:]) & set(eb[1:]))
        groups, at = [], 0
        for end in ends:
            ga = [x for x, e in zip(a, ea[1:]) if at < e <= end]
            gb = [x for x, e in zip(b, eb[1:]) if at < e <= end]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            at = end
        out.append([doc_id, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
        links_of.append(links)
    count = Counter(x for links in links_of for x in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(str((*row[:5], sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), row[5])) for row, links in zip(out, links_of))


def found(docs):
    from pyspark.sql import functions as F

    table = cut(alignment.aligned(docs, A, B).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))), "t")
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha)) for r in alignment.weighed(table).collect())


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_equals_comparing_all_ranges(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["the cat is here and the dog is there"] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (5, "the cat"), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_odd_rows(spark, odd, none):
    short = odd.filter("doc_id is null or doc_id <> 7")
    assert found(short) == brute([(r.doc_id, r.text) for r in short.collect()])
    assert found(none) == []
    long = cut(alignment.aligned(odd.filter("doc_id = 7"), A, B), "t").first()
    ta = Tokenizer.from_file(A)
    assert long.n_a == len(ta.encode(" " + odd.filter("doc_id = 7").first().text).ids) and long.n_groups > 60_000


def test_segments_do_not_change_the_ids():
    aligner = alignment.Aligner(A, B)
    r = random.Random(4)
    a, b = aligner.sides
    for _ in range(3000):
        text = "".join(r.choice(SIGNS.replace("▁", "")) for _ in range(r.randint(1, 25)))  # a text with that sign has no tokens
        parts = sum(aligner.segments(text), [])
        assert "".join(parts) == " " + text
        assert sum(a.encode(parts), []) == a.tokenizer.encode(" " + text, add_special_tokens=False).ids
        assert sum(b.encode(parts), []) == b.model.encode(text)


def test_long_texts_and_segments_given_up(monkeypatch):
    words = [f" w{i % 700}é." for i in range(3000)]
    text = "".join(words)[1:]
    whole = alignment.Aligner(A, B).texts([text, "a b", "x▁"])
    for name in ("LONG", "AT_ONCE", "KEPT"):
        monkeypatch.setattr(alignment, name, 50)
    aligner = alignment.Aligner(A, B)
    for _ in range(3):
        assert sum(aligner.segments(text), []) == words
        again = aligner.texts([text, "a b", "x▁"])
        assert (again[0] == whole[0]).all() and again[1].equals(whole[1])
        assert dict(zip(again[2].tolist(), again[3].tolist())) == dict(zip(whole[2].tolist(), whole[3].tolist()))
    assert len(aligner.known) < 3000 and whole[0][2].sum() == 0


@pytest.mark.parametrize("products", [1, 7, 1 << 20])
def test_product(products):
    r = np.random.default_rng(1)
    for _ in range(50):
        m, k, n = r.integers(1, 9, 3)
        left, right = r.integers(0, 2, (m, k)), r.integers(0, 2, (n, k))

        def csr(d):
            return ones(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]), np.nonzero(d)[1], d.shape[1])

        got = np.zeros((m, n), int)
        for first, block in product_blocks(csr(left), transposed(csr(right)), products):
            got[first + block.row_of(), block.column] += block.value
        assert (got == left @ right.T).all()
