"""Token ids of documents as binary files, written and read by a Spark data source.

A file holds the documents of one range of ids in ascending order. Each document is coded in
blocks of at most ``BLOCK`` ids by Simple-8b; behind the blocks stand the documents' ids and
lengths, every block's byte offset and its number of escapes, and a trailer that finds them.
Any document can be decoded on its own from its blocks' offsets.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tablescout.llm.pretokens import PLAIN, Numbers, spelled
from tablescout.llm.simple8b import pack, unpack
from tablescout.llm.texts import list_column, pieces
BLOCK = 4096  # ids of a block
FILE_BYTES = 64 << 20  # text bytes behind one file, on average
STEP_IDS = 1 << 20  # ids decoded at once
KEPT = 800_000  # words whose ids a worker keeps from task to task, some 160 MB, before it gives up the rare ones
OFTEN = 3  # times a word must have been seen to be kept on
AT_ONCE = 8192  # words encoded in one call
PIECE = 1 << 20  # text bytes handled at once
LONG = 1 << 20  # a longer text is split into words window by window
LOWEST = -1 << 63  # stands for null where rows are put in order
FIRST_LOOK = 512  # ranks looked up before it is known how many files there are
MAGIC = b"tokens8b"
TRAILER = "<QQQ8s"  # documents, blocks, place of the index
LISTING = "_files.json"


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word encoded once while it is kept.

    White space ends every word of such a tokenizer, so a text's ids are those of its words
    one after the other; other tokenizers are refused. Where the tokenizer takes both cases for
    one, plain texts are lower-cased first, which leaves fewer distinct words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters, self.bare = string.ascii_lowercase, False
        apart = self._ids(["a"])[0] + self._ids(["b"])[0]
        if any(x != apart for x in self._ids([f"a{s}b" for s in (" ", "\t", "\n", "\v", "\f", "\r", " \n ")] + [" a b "])):
            raise ValueError(f"{path} keeps white space")
        self.one_case = self._ids(list(letters)) == self._ids(list(letters.upper())) and self._ids([letters]) == self._ids([letters.upper()])
        shape = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda _: []
        whole, signs = letters + "éß", "".join(c for c in string.punctuation if c != "'")
        self.bare = (self.one_case and parts(whole + signs) == [(spelled(whole), (0, 28)), (signs, (28, 28 + len(signs)))]
                     and shape(whole.upper() + "ẞ" + signs) == letters + "éssß" + signs)
        self.signs: dict[str, list[int]] = {}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Numbers()
        self.seen = np.zeros(0, np.int32)
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _ids(self, words: list[str]) -> list[list[int]]:
        if self.bare:  # plain words pass the steps before the model in a known way, and model calls are cheaper
            pieces_of, plain, signs, out, rest = self.tokenizer.model.tokenize, PLAIN.fullmatch, self.signs, [], []
            for i, w in enumerate(words):
                if w.isascii() and w.isalpha():
                    out.append([t.id for t in pieces_of(w.lower())])
                elif m := plain(w):
                    ids = [t.id for t in pieces_of(spelled(m[1].lower()))]
                    if m[2]:
                        ids += signs[m[2]] if m[2] in signs else signs.setdefault(m[2], [t.id for t in pieces_of(m[2])])
                    out.append(ids)
                else:
                    out.append(None)
                    rest.append(i)
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
            return out
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, text: bytes) -> bytes:
        folded = text.lower()
        if any(s.lower() in folded for s in self.special):
            return text
        return folded if self.one_case and text.isascii() else text

    def _give_up_rare(self) -> None:
        keep = self.seen >= OFTEN
        self.flat, self.length = self.flat[np.repeat(keep, self.length)], self.length[keep]
        to, keep = (np.cumsum(keep) - 1).tolist(), keep.tolist()
        self.known = Numbers({w: to[i] for w, i in self.known.items() if keep[i]})
        self.seen = np.zeros(len(self.length), np.int32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each word's number of ids."""
        if len(self.known) > KEPT or len(self.flat) > 16 * KEPT:
            self._give_up_rare()
        own = words.dictionary_encode()  # a word is looked up once, however often it stands here
        number, fresh = self.known.of(own.dictionary.cast(pa.binary()).to_pylist())[own.indices.to_numpy()], self.known.fresh
        flat, length = [self.flat], [self.length]
        for at in range(0, len(fresh), AT_ONCE):
            ids = self._ids([w.decode() for w in fresh[at:at + AT_ONCE]])
            length.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(length[-1].sum())))
        self.known.fresh = []
        self.flat, self.length = np.concatenate(flat), np.concatenate(length)
        self.seen = np.concatenate([self.seen, np.zeros(len(fresh), np.int32)])
        self.seen += np.bincount(number, minlength=len(self.seen)).astype(np.int32)
        begin = np.cumsum(self.length, dtype=np.int64) - self.length
        size = self.length[number].astype(np.int64)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(begin[number] - (stop - size), size) + np.arange(total)], size

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's number of ids."""
        if len(texts) == 1 and len(texts[0]) > LONG:
            ids = [self._words(split([part])[0])[0] for part in windows(self._plain(texts[0]), LONG)]
            return np.concatenate(ids), np.array([sum(map(len, ids))])
        words, first = split([self._plain(text) for text in texts])
        ids, size = self._words(words)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[first])


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the place of each text's first one (one more entry closes the last text)."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    words = lists.values
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text gives an empty word
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[lists.offsets.to_numpy()]


def windows(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a text that end at white space, of ``limit`` bytes and the rest of a word."""
    blank, at = re.compile(rb"[\x20\x09-\x0D]"), 0
    while at < len(text):
        found = blank.search(text, at + limit)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def _encoder(kept, path: str, end_id: int, bounds: np.ndarray):
    """``kept``: a broadcast of an empty dict, of which each Python worker holds one copy for all its tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept.value.get("encoder") or kept.value.setdefault("encoder", WordEncoder(path))
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids, size = encoder.encode(part.column("text").cast(pa.binary()).to_pylist())
                ids, size = np.insert(ids, np.cumsum(size), np.uint32(end_id)), size + 1
                blocks = -(-size // BLOCK)
                block = np.full(int(blocks.sum()), BLOCK)
                block[np.cumsum(blocks) - 1] = size - (blocks - 1) * BLOCK
                coded, words, extra = pack(ids, block)
                ends = np.cumsum(np.add.reduceat(words + extra, np.cumsum(blocks) - blocks))
                data = coded.astype("<u8").tobytes()
                data = [data[8 * a:8 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                check = np.fromiter(map(zlib.crc32, data), np.int64, len(data))
                doc = part.column("doc_id").fill_null(LOWEST).to_numpy()
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array((low + check % (high - low + 1)).astype(np.int32)), pa.array(check), part.column("doc_id"), pa.array(size), pa.array(data, pa.binary()),
                     list_column(pa.array(words.astype(np.int32)), blocks), list_column(pa.array(extra.astype(np.int32)), blocks)],
                    names=["range", "tie", "doc_id", "n", "data", "words", "extra"])
    return run


@dataclass
class Written(WriterCommitMessage):
    number: int
    name: str
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow.fs import FileSystem

        system, folder = FileSystem.from_uri(self.path)
        number, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.s8b"
        doc, known, size, words, extra = [], [], [], [], []
        place = 0
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                column = {k: batch.column(k) for k in ("doc_id", "n", "data", "words", "extra")}
                known.append(column["doc_id"].is_valid().to_numpy(zero_copy_only=False))
                doc.append(column["doc_id"].fill_null(0).to_numpy())
                size.append(column["n"].to_numpy())
                words.append(column["words"].flatten().to_numpy())
                extra.append(column["extra"].flatten().to_numpy())
                for data in column["data"]:
                    out.write(data.as_buffer())
                    place += data.as_buffer().size
            doc, known, size, words, extra = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (doc, known, size, words, extra))
            offset = np.concatenate([[0], np.cumsum(8 * (words + extra))])
            for array, kind in ((doc, "<i8"), (size, "<i8"), (known, "u1"), (offset, "<i8"), (extra, "<u4")):
                out.write(array.astype(kind).tobytes())
            out.write(struct.pack(TRAILER, len(doc), len(words), place, MAGIC))
        return Written(number, name, int(size.sum()))

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSystem

        system, folder = FileSystem.from_uri(self.path)
        done = sorted((m.number, m.name, m.ids) for m in messages if m)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{LISTING}") as out:
            out.write(json.dumps([{"name": name, "ids": ids} for _, name, ids in done]).encode())

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileSystem

        system, folder = FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{folder}/{m.name}")


@dataclass
class File(InputPartition):
    name: str
    start: int


class TokenFile:
    """One open file: its index, and its ids step by step."""

    def __init__(self, source):
        self.source = source
        end, size = source.size(), struct.calcsize(TRAILER)
        docs, blocks, place, magic = struct.unpack(TRAILER, source.read_at(size, end - size))
        if magic != MAGIC:
            raise ValueError("no file of token ids")
        at = [place]

        def table(n, kind):
            data = source.read_at(n * np.dtype(kind).itemsize, at[0])
            at[0] += len(data)
            return np.frombuffer(data, kind)

        self.doc, self.size, self.known = table(docs, "<i8"), table(docs, "<i8"), table(docs, "u1").astype(bool)
        self.offset, self.extra = table(blocks + 1, "<i8"), table(blocks, "<u4").astype(np.int64)
        many = -(-self.size // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(many)])
        self.block = np.full(blocks, BLOCK)
        filled = many > 0
        self.block[self.first_block[1:][filled] - 1] = (self.size - (many - 1) * BLOCK)[filled]

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b."""
        at, to = int(self.offset[a]), int(self.offset[b])
        coded = np.frombuffer(self.source.read_at(to - at, at), "<u8")
        extra = self.extra[a:b]
        return unpack(coded, np.diff(self.offset[a:b + 1]) // 8 - extra, extra, self.block[a:b]).astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from its blocks alone."""
        return self.blocks(int(self.first_block[i]), int(self.first_block[i + 1]))

    def steps(self) -> Iterator[np.ndarray]:
        stop = np.cumsum(self.block)
        at = 0
        while at < len(self.block):
            before = int(stop[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(stop, before + STEP_IDS, "right")))
            yield self.blocks(at, to)
            at = to


class _Reader(DataSourceReader):
    def __init__(self, path: str, ids: bool):
        self.path, self.ids = path, ids

    def partitions(self) -> list[File]:
        from pyarrow.fs import FileSystem

        system, folder = FileSystem.from_uri(self.path)
        with system.open_input_stream(f"{folder}/{LISTING}") as listing:
            files = json.loads(listing.read())
        start = np.cumsum([0] + [f["ids"] for f in files])
        return [File(f["name"], int(a)) for f, a in zip(files, start)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, folder = FileSystem.from_uri(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as source:
            file = TokenFile(source)
            stop = np.cumsum(file.size)
            done, at, crc, open_ids = 0, 0, 0, []
            for ids in file.steps():
                first, values = done, []
                while done < len(stop) and stop[done] <= at + len(ids):
                    a, b = max(0, int(stop[done] - file.size[done]) - at), int(stop[done]) - at
                    values.append(np.concatenate([*open_ids, ids[a:b]]) if self.ids else zlib.crc32(ids[a:b], crc))
                    crc, open_ids = 0, []
                    done += 1
                if done < len(stop):  # the rest belongs to a document that goes on
                    a = max(0, int(stop[done] - file.size[done]) - at)
                    crc = zlib.crc32(ids[a:], crc)
                    open_ids += [ids[a:]] if self.ids else []
                at += len(ids)
                if done > first:
                    own = slice(first, done)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc[own], mask=~file.known[own]), pa.array(partition.start + stop[own] - file.size[own]), pa.array(file.size[own]),
                         pa.array(values, pa.list_(pa.int64())) if self.ids else pa.array(values, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids" if self.ids else "ids_crc32"])


class TokenIds(DataSource):
    """``spark.read.format("token_ids")``: one row per document; option ``ids`` gives the ids instead of their checksum."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def _whole(self) -> bool:
        return self.options.get("ids", "false") == "true"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("ids array<long>" if self._whole() else "ids_crc32 long")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._whole())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _ranges(texts: DataFrame, file_bytes: int, places: int) -> tuple[np.ndarray, int]:
    """Bounds of the ranges of doc_id, out of ``places`` evenly spaced ranks, and the number of files wanted."""
    key = F.coalesce("doc_id", F.lit(LOWEST))
    size, ranks = texts.agg(F.sum(F.octet_length("text")), F.percentile_approx(
        key, [i / places for i in range(1, places)], max(10_000, 20 * places))).first()
    files = max(1, -(-(size or 0) // file_bytes))
    ranks = np.array(ranks or [], np.int64)
    return ranks[np.arange(1, files) * places // files - 1] if len(ranks) and files <= places else ranks[:0], files


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` by the tokenizer file ``path``, end each with ``end_id``, and write them in ascending doc_id order.

    ``folder`` is any place that pyarrow and all executors can reach. Ids are coded where the
    text is read, and only codes are shuffled, to ranges of doc_id with about equally many rows;
    an id that many rows share takes several ranges. Each file is written by one task under a
    name of its own; only the listing, written last, makes files count, so a task that is run
    again leaves none twice.

    A null or empty text is the end id alone; null ids come first; repeated rows are written
    each, in the order of their checksums; other columns are ignored; an empty table gives no
    documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, files = _ranges(texts, file_bytes, FIRST_LOOK)
    if files > FIRST_LOOK:
        bounds, files = _ranges(texts, file_bytes, files)
    kept = spark.sparkContext.broadcast({})
    coded = texts.mapInArrow(_encoder(kept, path, end_id, bounds),
                             "range int, tie long, doc_id long, n long, data binary, words array<int>, extra array<int>")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("data")]
    spark.dataSource.register(TokenIds)
    (coded.repartitionById(files, F.col("range")).sortWithinPartitions(*order)
     .drop("range", "tie").write.format("token_ids").mode("append").save(folder))


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or ids) of every document of the files in ``folder``.

    ``start`` counts the ids of all documents before it. Files are decoded step by step.
    """
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("ids", str(ids).lower()).load(folder)
