"""Toxic spans and document scores by a linear-chain conditional random field.

A chain is a sentence, cut after ``CHAIN`` tokens. Token labels come from document labels:
in a toxic training document those tokens are toxic of which a feature (the word, or its
first 5, 6 or 7 letters) is much more frequent in toxic documents. Forward-backward gives
each token's marginal; the marginals of a document give its score and offending offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.texts import BASE, list_column, mix, pieces, shared
from tablescout.session import cut

BITS = 20  # feature hashes; the weights take 4 MB whatever the corpus
PREFIXES = (5, 6, 7)
WIDTH = 1 + len(PREFIXES)
CHAIN = 64
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000  # labelled rows, about, that the model is fitted on
MIN_DOCS, MIN_GAIN, MIN_CHI2 = 4, 1.0, 15.0  # when a feature marks tokens of toxic documents
STEPS, RATE, DECAY = 120, 0.15, 1e-4


class TokenReader:
    """Letter runs of texts with hashed features; letters are lower-cased."""

    def __init__(self):
        self.codes = np.full(0x110000, -2, np.int32)  # -2 unseen, -1 no letter, -3 ends a sentence

    def _learn(self, codes: np.ndarray) -> None:
        for code in codes:
            c = chr(code)
            low = c.lower()
            self.codes[code] = (ord(low) if len(low) == 1 else code) if c.isalpha() else -3 if c in ".!?\n" else -1

    def read(self, texts: list[str]):
        """Row, start and end in the row, chain number and feature places of every token."""
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        offs = np.cumsum(size) - size
        code = self.codes[raw]
        if (code == -2).any():
            self._learn(np.unique(raw[code == -2]))
            code = self.codes[raw]
        letter = code >= 0
        rise = letter.copy()
        rise[1:] &= ~letter[:-1]
        fall = letter.copy()
        fall[:-1] &= ~letter[1:]
        start, end = np.flatnonzero(rise), np.flatnonzero(fall) + 1
        row = np.searchsorted(offs, start, "right") - 1
        power = np.full(len(raw), BASE, np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(np.where(letter, code + 1, 0).astype(np.uint64) * power, out=total[1:])
        back = np.full(len(raw), pow(BASE, -1, 1 << 64), np.uint64)
        back[:1] = 1
        np.cumprod(back, out=back)
        place = np.zeros((len(start), WIDTH), np.int64)  # place 0 stands for no feature
        for j, m in enumerate((None, *PREFIXES)):
            stop = end if m is None else np.minimum(start + m, end)
            h = mix((total[stop] - total[start]) * back[start] + np.uint64(j + 1)) >> np.uint64(64 - BITS) if len(start) else np.zeros(0, np.uint64)
            place[:, j] = np.maximum(h.astype(np.int64), 1)
            if m is not None:
                place[end - start < m, j] = 0
        ends = np.cumsum(code == -3)[start] if len(start) else np.zeros(0, np.int64)
        new = np.ones(len(start), bool)
        new[1:] = ends[1:] != ends[:-1]  # a sentence end lies between, or a row's end
        first = np.flatnonzero(new)
        within = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start)))) if len(start) else start
        new |= within % CHAIN == 0
        return row, start - offs[row], end - offs[row], np.cumsum(new) - 1, place


def _marginals(emit: np.ndarray, chain: np.ndarray, start: float, step: np.ndarray, pairs: bool = False):
    """P(toxic) of every token, and for training the log of Z and expected transitions.

    Messages are kept as log-odds and log-sums per position; all chains advance together.
    """
    n = len(emit)
    if not n:
        return (np.zeros(0), 0.0, np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
    first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    a = np.empty((n, 2))
    b = np.zeros((n, 2))
    longest = int(size[0])
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains longer than t
    a[first, 0], a[first, 1] = 0.0, start + emit[first]
    for t in range(1, longest):
        at = first[:active[t]] + t
        p0, p1 = a[at - 1, 0], a[at - 1, 1]
        a[at, 0] = np.logaddexp(p0 + step[0, 0], p1 + step[1, 0])
        a[at, 1] = np.logaddexp(p0 + step[0, 1], p1 + step[1, 1]) + emit[at]
    for t in range(longest - 2, -1, -1):
        at = first[:active[t + 1]] + t
        q0, q1 = b[at + 1, 0], b[at + 1, 1] + emit[at + 1]
        b[at, 0] = np.logaddexp(step[0, 0] + q0, step[0, 1] + q1)
        b[at, 1] = np.logaddexp(step[1, 0] + q0, step[1, 1] + q1)
    gap = (a[:, 1] + b[:, 1]) - (a[:, 0] + b[:, 0])
    p = 1 / (1 + np.exp(np.clip(-gap, -500, 500)))
    if not pairs:
        return p
    z = np.logaddexp(a[first, 0] + b[first, 0], a[first, 1] + b[first, 1])
    per = np.empty(n)
    rank = np.repeat(np.arange(len(first)), size)
    per[np.concatenate([np.arange(f, f + s) for f, s in zip(first, size)])] = z[rank]
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    expect = np.empty((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            expect[i, j] = np.exp(a[at - 1, i] + step[i, j] + (emit[at] if j else 0.0) + b[at, j] - per[at]).sum()
    return p, float(z.sum()), expect, float(p[first].sum())


@dataclass
class Tagger:
    weight: np.ndarray  # by feature place, place 0 is 0
    bias: float
    start: float
    step: np.ndarray

    def tag(self, chain: np.ndarray, place: np.ndarray) -> np.ndarray:
        return _marginals(self.weight[place].sum(axis=1) + self.bias, chain, self.start, self.step)


def fit_tagger(chain: np.ndarray, place: np.ndarray, truth: np.ndarray) -> Tagger:
    """Maximum likelihood with weight decay by Adam on all chains at once."""
    used, where = np.unique(place, return_inverse=True)
    where = where.reshape(place.shape)
    x = np.zeros(len(used) + 5)
    x[len(used)] = -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    first = np.append(True, chain[1:] != chain[:-1])
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    count = max(1, len(truth))
    for turn in range(1, STEPS + 1):
        w, bias, start, s01, s10, s11 = x[:-5], x[-5], x[-4], x[-3], x[-2], x[-1]
        step = np.array([[0.0, s01], [s10, s11]])
        w = np.where(used == 0, 0.0, w)
        p, _, expect, p_first = _marginals(w[where].sum(axis=1) + bias, chain, start, step, pairs=True)
        off = p - truth
        grad = np.concatenate([
            np.bincount(where.ravel(), np.repeat(off, place.shape[1]), minlength=len(used)),
            [off.sum(), p_first - truth[first].sum(), expect[0, 1] - seen[0, 1], expect[1, 0] - seen[1, 0], expect[1, 1] - seen[1, 1]]]) / count
        grad[:-5] += DECAY * x[:-5] / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x -= RATE * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-7)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = np.where(used == 0, 0.0, x[:-5])
    return Tagger(weight, float(x[-5]), float(x[-4]), np.array([[0.0, x[-3]], [x[-2], x[-1]]]))


def _feature_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, count = TokenReader(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                row, _, _, _, place = reader.read(part.column("text").to_pylist())
                label = part.column("toxic").to_numpy()
                key = np.unique((row[:, None] << BITS | place).ravel())
                key = key[(key & ((1 << BITS) - 1)) > 0]
                for y in (0, 1):
                    own = key[label[key >> BITS] == y] & ((1 << BITS) - 1)
                    count[y] += np.bincount(own, minlength=1 << BITS)
        some = np.flatnonzero(count.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[0, some]), pa.array(count[1, some])], names=["place", "clean", "toxic"])
    return run


def _chains(shared):
    """Chains to learn from: those with a marked token and one other of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, reader = np.zeros(1 << BITS, bool), TokenReader()
        marked[shared.value] = True
        for batch in batches:
            for part in pieces(batch, "text"):
                row, _, _, chain, place = reader.read(part.column("text").to_pylist())
                if not len(row):
                    continue
                label = part.column("toxic").to_numpy()
                hit = marked[place].any(axis=1)
                first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
                size = np.diff(np.append(first, len(chain)))
                take = np.bincount(chain, hit) > 0
                owner = row[first]
                for d in np.unique(owner):
                    own = np.flatnonzero((owner == d))
                    take[own[int(mix(np.array([place[first[own[0]], 0]], np.uint64))[0]) % len(own)]] = True
                keep = take[chain]
                yield pa.RecordBatch.from_arrays(
                    [list_column(pa.array(place[keep].ravel()), size[take] * WIDTH),
                     list_column(pa.array((hit & (label[row] == 1))[keep].astype(np.int8)), size[take])], names=["place", "truth"])
    return run


def _tagged(tagger_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, reader = tagger_of(), TokenReader()
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for part in pieces(batch, "text"):
                row, start, end, chain, place = reader.read(part.column("text").to_pylist())
                p = tagger.tag(chain, place)
                n = part.num_rows
                peak = np.zeros(n)
                np.maximum.at(peak, row, p)
                bad = np.flatnonzero(p >= 0.5)
                new = np.ones(len(bad), bool)
                new[1:] = (np.diff(bad) > 1) | (chain[bad][1:] != chain[bad][:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(bad))[:len(head)] - 1
                spans = pa.StructArray.from_arrays(
                    [pa.array(start[bad[head]].astype(np.int32)), pa.array(end[bad[tail]].astype(np.int32))], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, p, minlength=n).astype(float)), pa.array(peak),
                     list_column(spans, np.bincount(row[bad[head]], minlength=n))], names=["row", "tokens", "mass", "peak", "spans"])
    return run


def tagged(rows: DataFrame, tagger: Tagger) -> DataFrame:
    """row, tokens, mass (sum of marginals), peak (largest), spans at 0.5 or more."""
    schema = T.StructType([
        rows.schema["row"], T.StructField("tokens", T.LongType()), T.StructField("mass", T.DoubleType()), T.StructField("peak", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return rows.select("row", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_tagged(shared(rows.sparkSession, tagger)), schema)


def _signs():
    """What the document score sees: peak, mass, and mass against length."""
    rate = F.col("mass") / F.sqrt(F.col("tokens") + 1.0)
    return [F.col("peak"), F.log1p("mass"), F.log1p(rate * 10), F.log1p(F.col("tokens").cast("double")) / 10]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, constant last, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with score and spans added; ``training`` has doc_id, text, toxic (0 or 1).

    ``labels``: doc_id and toxic, where ``training`` has no such column. Then the rows to learn
    from are chosen by their ids alone, and only their texts are fetched.

    The model is fitted on about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` training rows with the
    smallest id hashes; every row is scored on its whole text. ``spans`` are code point
    offsets of tokens whose marginal is 0.5 or more, neighbours joined.

    A null or empty text scores what a document without any token scores. Without rows of
    both labels every score is the share of toxic ones, 0 without any. Training rows
    without text or label teach nothing; repeated rows count each; columns called score
    or spans are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("score", "spans")]
    rows = training.filter("text IS NOT NULL")
    known = rows.select("doc_id", F.col("toxic").cast("int")) if labels is None else rows.select("doc_id").join(
        labels.select("doc_id", F.col("toxic").cast("int")), "doc_id")
    known = known.filter("toxic IN (0, 1)")
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        empty = F.array().cast("array<struct<start:int,end:int>>")
        return docs.select(*names, F.lit(1.0 if n.get(1) else 0.0).alias("score"), empty.alias("spans"))
    share = {1: min(1.0, TOXIC_ROWS / n[1]), 0: min(1.0, CLEAN_ROWS / n[0])}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    chosen = place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    if labels is None:
        sample = rows.select("doc_id", F.col("text").cast("string"), F.col("toxic").cast("int")).filter("toxic IN (0, 1)").filter(chosen)
    else:  # few ids, by the two bounds
        ids = cut(labels.select("doc_id", F.col("toxic").cast("int")).filter("toxic IN (0, 1)").filter(chosen).join(
            rows.select("doc_id").distinct(), "doc_id", "left_semi"), "chosen")
        sample = rows.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    sample = cut(sample, "labelled")
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    stats = sample.select("text", "toxic").mapInArrow(_feature_counts(), "place long, clean long, toxic long").groupBy("place").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    nt, nc = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    c, t = F.col("c"), F.col("t")
    gain = F.log(((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1)))
    chi2 = F.pow(t * F.lit(float(nc)) - c * F.lit(float(nt)), 2) * (nt + nc) / (F.lit(float(nt)) * nc * (t + c) * F.greatest(nt + nc - t - c, F.lit(1)))
    marks = np.array([r[0] for r in stats.filter((t >= MIN_DOCS) & (gain >= MIN_GAIN) & (chi2 >= MIN_CHI2)).select("place").collect()], np.int64)
    got = sample.select("text", "toxic").mapInArrow(_chains(spark.sparkContext.broadcast(marks)), "place array<long>, truth array<byte>").toArrow()
    truth = got.column("truth").combine_chunks()
    chain = np.repeat(np.arange(len(truth)), truth.value_lengths().to_numpy())
    tagger = fit_tagger(chain, got.column("place").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH),
                        truth.flatten().to_numpy().astype(np.int64))
    seen = tagged(sample.select(F.struct("toxic").alias("row"), "text"), tagger).select("row.toxic", *[s.alias(f"s{i}") for i, s in enumerate(_signs())]).toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    x = np.column_stack([seen.column(f"s{i}").to_numpy() for i in range(len(_signs()))])
    w = _logistic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    out = tagged(docs.select(F.struct(*[docs[x] for x in names]).alias("row"), docs["text"].cast("string").alias("text")), tagger)
    z = F.lit(float(w[-1]))
    for s, v in zip(_signs(), w):
        z = z + s * F.lit(float(v))
    return out.select("row.*", (1 / (1 + F.exp(-z))).alias("score"), "spans")
