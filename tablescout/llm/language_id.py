"""Language ID by interpolated Kneser-Ney character models.

Counts of character 4-grams come from every training text. Discounted probabilities and
back-off weights of orders 4 to 1 are computed by Spark on exact n-grams and stored per
language and order in sorted arrays of n-gram hashes. Hashes are folded to as many bits as
keep the whole model under ``MODEL_BYTES`` whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.pretokens import Interner
from tablescout.llm.texts import mix, pieces, shared
from tablescout.operators.order import exact_quantiles
from tablescout.session import cut

ORDER = 4
MODEL_BYTES = 256 << 20
PIECE = 1 << 18  # text bytes handled at once: some 60 bytes a character are held for them
FLUSH = 1 << 20  # distinct n-grams a task gathers per language before it hands them on
KNOWN = 1 << 20  # n-grams whose probabilities a task keeps before it starts anew
SHARPNESS = (1, 2, 4, 8, 16, 32, 64)  # candidates for the exponent of the score
QUANTILE = 0.999  # of the training rows recognised as their own language
MARGIN = 1.0  # nats per character above that quantile at which a text is rejected


class Reader:
    """Texts as packed character n-grams: letters lower-cased, each gap one blank."""

    def __init__(self):
        self.codes = np.full(0x110000, -1, np.int32)

    def _learn(self, codes: np.ndarray) -> None:
        for code in codes:
            c = chr(code)
            if not c.isalpha():
                self.codes[code] = 32
                continue
            low = c.lower()
            value = ord(low) if len(low) == 1 else code
            self.codes[code] = value if value < 65536 else (value * 0x9E3779B1 >> 16) & 0xFFFF

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed 4-grams, the row of each, and the number of letters of each row."""
        parts = ["\0\0\0 " + t + " " for t in texts]
        raw = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        size = np.array([len(p) for p in parts], np.int64)
        offs = np.cumsum(size) - size
        code = self.codes[raw]
        if (code < 0).any():
            self._learn(np.unique(raw[code < 0]))
            code = self.codes[raw]
        letter = code != 32
        row = np.repeat(np.arange(len(texts)), size)
        pad = np.zeros(len(raw), bool)
        for j in range(ORDER - 1):
            pad[offs + j] = True
        letters = np.bincount(row[letter], minlength=len(texts))
        keep = letter | pad
        keep[1:] |= letter[:-1]
        keep[offs + ORDER - 1] = True
        code, row, pad = np.where(pad, 0, code)[keep].astype(np.uint64), row[keep], pad[keep]
        gram = code.copy()
        for j in range(1, ORDER):
            gram[j:] |= code[:-j] << np.uint64(16 * j)
        real = ~pad
        return gram[real], row[real], letters


def _counter():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(), {}

        def handed(lang):
            seen, count = held.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen.keys.view(np.int64)), pa.array(count)], names=["lang", "g", "n"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                gram, row, _ = reader.grams(part.column("text").to_pylist())
                langs = pc.dictionary_encode(part.column("lang"))
                which = langs.indices.to_numpy()[row]
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    seen, count = held.get(lang) or (Interner(), np.zeros(0, np.int64))
                    number, _ = seen.number(gram[which == i])
                    count = np.concatenate([count, np.zeros(len(seen) - len(count), np.int64)])
                    held[lang] = seen, count + np.bincount(number, minlength=len(count))
                    if len(seen) > FLUSH:
                        yield handed(lang)
        for lang in list(held):
            yield handed(lang)
    return run


def _bits(langs: int) -> int:
    """Hash bits at which 7 tables of 12-byte entries per language stay under the bound."""
    return max(8, min(24, int(log2(MODEL_BYTES / (7 * 12 * max(1, langs))))))


@dataclass
class Model:
    """Sorted hashes and values per order: ``gain`` of n-grams, ``back`` of contexts."""

    langs: list[str]
    bits: int
    gain: list[list[tuple[np.ndarray, np.ndarray]]]
    back: list[list[tuple[np.ndarray, np.ndarray]]]
    floor: list[float]

    @staticmethod
    def _get(table, key):
        hashes, values = table
        if not len(hashes):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
        hit = hashes[at] == key
        return np.where(hit, values[at], 0.0), hit

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of p(last character | three before it), a column per language."""
        out = np.empty((len(grams), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            p = np.full(len(grams), self.floor[i])
            for k in range(1, ORDER + 1):
                own = grams & np.uint64((1 << 16 * k) - 1) if k < ORDER else grams
                gain, _ = self._get(self.gain[i][k - 1], fold(own, k, self.bits))
                if k > 1:
                    back, known = self._get(self.back[i][k - 1], fold(own >> np.uint64(16), k + 16, self.bits))
                    p = np.where(known, gain + back * p, p)
                else:
                    p = gain + p
            out[:, i] = np.log(p)
        return out


def fold(gram: np.ndarray, table: int, bits: int) -> np.ndarray:
    return (mix(gram ^ np.uint64(table << 58 & (1 << 64) - 1) ^ np.uint64(table)) >> np.uint64(64 - bits)).astype(np.uint32)


def _folder(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            g = batch.column("g").to_numpy().view(np.uint64)
            h = np.zeros(len(g), np.int64)
            for k in np.unique(kind):
                h[kind == k] = fold(g[kind == k], int(k), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("kind"), pa.array(h), batch.column("v")], names=["lang", "kind", "h", "v"])
    return run


def train(rows: DataFrame) -> Model:
    """Model of all (lang, text) rows; both columns are set."""
    counts = cut(rows.select("lang", "text").mapInArrow(_counter(), "lang string, g long, n long")
                 .groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    level = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before
        mask = F.lit((1 << 16 * k) - 1)
        level[k] = level[k + 1].select("lang", F.col("g").bitwiseAND(mask).alias("g")).groupBy("lang", "g").agg(
            F.count("*").alias("n"))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    bits = _bits(len(langs))
    floor = dict.fromkeys(langs, 1.0)
    entries = None
    for k in range(1, ORDER + 1):
        c = level[k] if k == ORDER else cut(level[k], "order")
        d = {r["lang"]: (r["a"] / (r["a"] + 2 * r["b"]) if r["a"] else 0.5) for r in c.groupBy("lang").agg(
            F.sum((F.col("n") == 1).cast("long")).alias("a"), F.sum((F.col("n") == 2).cast("long")).alias("b")).collect()}
        # a discount of 1 would leave nothing to n-grams seen once
        discount = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(d[lang], 0.95)))])[F.col("lang")] if langs else F.lit(0.5)
        context = F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long")
        c = c.withColumn("c", context)
        total = c.groupBy("lang", "c").agg(F.sum("n").alias("t"), F.count("*").alias("f"))
        gain = c.join(total, ["lang", "c"]).select("lang", F.lit(k).alias("kind"), "g", ((F.col("n") - discount) / F.col("t")).alias("v"))
        rest = total.select("lang", F.lit(k + 16).alias("kind"), F.col("c").alias("g"), (discount * F.col("f") / F.col("t")).alias("v"))
        if k == 1:
            floor |= {r["lang"]: r["v"] / 65536 for r in rest.collect()}
            entries = gain
        else:
            entries = entries.union(gain).union(rest)
    folded = entries.mapInArrow(_folder(bits), "lang string, kind int, h long, v double").groupBy("lang", "kind", "h").agg(F.max("v").alias("v"))
    table = folded.select("lang", "kind", "h", F.col("v").cast("float")).toArrow()  # at most MODEL_BYTES by ``bits``
    lang, kind = np.array(table.column("lang").to_pylist(), object), table.column("kind").to_numpy()
    h, v = table.column("h").to_numpy().astype(np.uint32), table.column("v").to_numpy()

    def sorted_table(name, k):
        own = (lang == name) & (kind == k)
        order = np.argsort(h[own])
        return h[own][order], v[own][order]

    return Model(langs, bits, [[sorted_table(x, k) for k in range(1, ORDER + 1)] for x in langs],
                 [[sorted_table(x, k + 16) for k in range(1, ORDER + 1)] for x in langs], [floor[x] for x in langs])


def _scorer(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = model_of(), Reader()
        seen, known = Interner(), np.zeros((0, len(model.langs)), np.float32)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                if len(seen) > KNOWN:
                    seen, known = Interner(), known[:0]
                gram, row, letters = reader.grams(part.column("text").to_pylist())
                number, fresh = seen.number(gram)
                if len(fresh):
                    known = np.concatenate([known, model.log_prob(gram[fresh])])
                first = np.searchsorted(row, np.arange(part.num_rows))
                loss = -np.add.reduceat(known[number], first, axis=0, dtype=np.float64) if part.num_rows else known[:0]
                loss /= np.bincount(row, minlength=part.num_rows)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(letters), pa.array(list(loss), pa.list_(pa.float64()))], names=["row", "letters", "loss"])
    return run


def losses(rows: DataFrame, model: Model) -> DataFrame:
    """row, letters, loss: cross-entropy in nats per character, one number per language."""
    schema = T.StructType([rows.schema["row"], T.StructField("letters", T.LongType()),
                           T.StructField("loss", T.ArrayType(T.DoubleType()))])
    return rows.select("row", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_scorer(shared(rows.sparkSession, model)), schema)


def _likelihood(sharp: float) -> Column:
    return F.aggregate(F.transform("loss", lambda x: F.exp(F.lit(float(sharp)) * (F.array_min("loss") - x))), F.lit(0.0), lambda a, b: a + b)


def calibrate(rows: DataFrame, model: Model) -> tuple[float, list[float]]:
    """Sharpness of the score and the rejection bound of each language, fitted on all training rows."""
    truth = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("row.lang")).cast("int")
    got = cut(losses(rows.select(F.struct("lang").alias("row"), "text"), model).filter("letters > 0").select(
        truth.alias("truth"), "loss"), "losses")
    own = F.element_at("loss", F.col("truth")) - F.array_min("loss")
    fit = got.agg(*[F.avg(b * own + F.log(_likelihood(b))).alias(f"b{b}") for b in SHARPNESS]).head()
    sharp = min(SHARPNESS, key=lambda b: np.inf if fit[f"b{b}"] is None else fit[f"b{b}"])
    right = got.filter(F.array_position("loss", F.array_min("loss")) == F.col("truth")).groupBy(
        "truth", F.array_min("loss").alias("value")).agg(F.count("*").alias("n"))
    top = {r["truth"]: r["q"] for r in exact_quantiles(right, "truth", "value", "n", [QUANTILE]).collect()}
    return float(sharp), [top[i] + MARGIN if i in top else np.inf for i in range(1, len(model.langs) + 1)]


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added; ``training`` has doc_id, lang, text.

    The language with the lowest cross-entropy per character wins, ties go to the first in
    order of name. ``score`` is its calibrated posterior. ``rejected`` marks texts that fit
    no learned language: no letter, or a cross-entropy beyond the bound of the winner.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text when nothing could be learned. Rows of ``training`` without text or lang teach
    nothing. Repeated rows and null ids are answered each on their own. Columns called
    lang_pred, score, rejected or loss are replaced.
    """
    taught = training.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected", "loss")]
    model = train(taught)
    if not model.langs:
        return docs.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sharp, bound = calibrate(taught, model)
    row = F.struct(*[docs[c] for c in names])
    out = losses(docs.select(row.alias("row"), docs["text"].cast("string").alias("text")), model)
    best = F.array_position("loss", F.array_min("loss")).cast("int")
    known = F.col("letters") > 0
    over = F.array_min("loss") > F.element_at(F.array(*[F.lit(b) for b in bound]), best)
    return out.select(
        "row.*", F.when(known, F.element_at(F.array(*[F.lit(x) for x in model.langs]), best)).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / _likelihood(sharp)).otherwise(0.0).alias("score"), (~known | over).alias("rejected"), "loss")


def recognised(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The documents that ``identify`` does not reject, with their own columns, whatever they are called."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), docs["text"].alias("text"))
    return identify(packed, training).filter("NOT rejected").select("own.*")
