"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.pretokens import Interner, Splitter, texts_of
from tablescout.llm.texts import KeyTable, list_column, pieces, shared, signed
from tablescout.session import cut

HEAD = 1 << 18  # most frequent pre-tokens that every task holds: 12 bytes each, 3 MB
PIECE = 1 << 18  # text bytes handled at once
FLUSH = 1 << 19  # distinct pre-tokens a task gathers before it hands them on


def _vocabulary(splitter_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen, words, count = splitter_of(), Interner(), [], np.zeros(0, np.int64)  # words: Arrow arrays, a few bytes a word

        def handed():
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(seen.keys)), pa.concat_arrays(words), pa.array(count)], names=["h", "word", "n"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                parts, _, _ = splitter.segments(part.column("text").to_pylist())
                codes, start, end, value, _ = splitter.split(parts)
                number, fresh = seen.number(value)
                words.append(pa.array(texts_of(codes, start[fresh], end[fresh]), pa.string()))
                count = np.concatenate([count, np.zeros(len(seen) - len(count), np.int64)])
                count += np.bincount(number, minlength=len(count))
                if len(seen) > FLUSH:
                    yield handed()
                    seen, words, count = Interner(), [], np.zeros(0, np.int64)
        if len(seen):
            yield handed()
    return run


def _piece_counter(splitter_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = splitter_of().tokenizer
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                got = tokenizer.encode_batch_fast(part.column("word").to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), part.column("n"), pa.array([len(e) for e in got], pa.int32())], names=["h", "n", "pieces"])
    return run


def _frequencies(splitter_of, head_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, (head, head_pieces) = splitter_of(), head_of()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = part.column("text").to_pylist()
                parts, row, after = splitter.segments(texts)
                _, start, _, value, first = splitter.split(parts)
                doc = np.repeat(row, np.diff(first))
                at = head.find(value)
                known = at >= 0
                tokens = np.bincount(doc[known], head_pieces[at[known]], minlength=len(texts)).astype(np.int64)
                tokens += np.bincount(row[after >= 0], minlength=len(texts))
                tail_doc, tail = doc[~known], value[~known]
                order = np.lexsort((tail, tail_doc))
                tail_doc, tail = tail_doc[order], tail[order]
                new = np.ones(len(tail), bool)
                new[1:] = (tail[1:] != tail[:-1]) | (tail_doc[1:] != tail_doc[:-1])
                place = np.flatnonzero(new)
                n = np.diff(np.append(place, len(tail)))
                per = np.bincount(tail_doc[place], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pc.cast(pc.binary_length(part.column("text")), pa.int64()),
                     pa.array(tokens), list_column(pa.array(signed(tail[place])), per), list_column(pa.array(n.astype(np.int32)), per)],
                    names=["row", "doc_id", "n_bytes", "head", "tail", "times"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``.

    Counts are those of the tokenizer file without added begin or end tokens; its special
    strings inside a text count one each. Every distinct pre-token is cut into pieces once.
    The most frequent ``HEAD`` pre-tokens, a table of fixed size, are summed where the text
    is read; only (document, pre-token, times) rows of rarer ones are shuffled and joined.

    A null text is empty and has 0 tokens; a null doc_id keeps its row; repeated rows are
    counted each on their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    splitter = shared(spark, Splitter(path))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = (texts.mapInArrow(_vocabulary(splitter), "h long, word string, n long")
             .groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("n")))
    counted = cut(words.mapInArrow(_piece_counter(splitter), "h long, n long, pieces int"), "pieces")
    top = counted.orderBy(F.desc("n"), "h").limit(HEAD).select("h", "pieces").toArrow()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = KeyTable(top.column("h").to_numpy().view(np.uint64)), top.column("pieces").to_numpy().astype(np.int64)
    found = rows.mapInArrow(
        _frequencies(splitter, shared(spark, head)),
        "row long, doc_id long, n_bytes long, head long, tail array<long>, times array<int>")
    found = cut(found, "frequencies")
    rare = (found.filter("size(tail) > 0").select("row", F.explode(F.arrays_zip("tail", "times")).alias("t"))
            .join(counted.select(F.col("h").alias("tail"), "pieces"), F.col("t.tail") == F.col("tail"))
            .groupBy("row").agg(F.sum(F.col("t.times").cast("long") * F.col("pieces")).alias("rare")))
    out = found.join(rare, "row", "left").select(
        "doc_id", "n_bytes", (F.col("head") + F.coalesce("rare", F.lit(0).cast("long"))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
