"""Links between the tokens that two tokenizers cut one text into.

A text is cut into segments at spaces that follow other signs. Neither tokenizer has a token
across such a place, so both end a token there, and a text's tokens, groups and links are
those of its segments one after the other. Each distinct segment is aligned once.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.csr import Csr, ones, product_blocks, transposed
from tablescout.llm.pretokens import PLAIN, Interner, Numbers, byte_signs, spelled
from tablescout.llm.texts import list_column, pieces, signed, utf8
from tablescout.session import cut

KEPT = 300_000  # aligned segments that a worker keeps from task to task, some 90 MB, before it gives up the rare ones
OFTEN = 3  # times a segment must have been seen to be kept on
AT_ONCE = 1 << 18  # segments of one text that are looked up at once
FRESH = 16_384  # new segments aligned at once
PIECE = 1 << 20  # text bytes handled at once
LONG = 1 << 20  # characters of a text that are cut into segments at once
HEAD = 1 << 18  # most frequent id pairs that every task holds: 17 bytes each, 4.5 MB
SEGMENT = re.compile(r" \s*(?:\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?)?")
CUT = re.compile(r"\S(?= )")


class ByteBpe:
    """Token ids and token bytes of a byte-level BPE file; its special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        signs = {sign: b for b, sign in byte_signs().items()}
        self.bytes = {i: bytes(signs.get(c, 63) for c in token) for token, i in self.tokenizer.get_vocab().items()}

        parts, signs = self.tokenizer.pre_tokenizer.pre_tokenize_str, "".join(c for c in string.punctuation if c != "'")
        self.bare = self.tokenizer.normalizer is None and parts(" aéſ" + signs) == [("Ġ" + spelled("aéſ"), (0, 4)), (signs, (4, 4 + len(signs)))]
        self.signs: dict[str, list[int]] = {}

    def encode(self, segments: list[str]) -> list[list[int]]:
        if not self.bare:
            return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        # a space, letters and signs are cut in a known way, and model calls are cheaper
        pieces_of, plain, signs, out, rest = self.tokenizer.model.tokenize, PLAIN.fullmatch, self.signs, [], []
        for i, s in enumerate(segments):
            if m := plain(s, 1):
                ids = [t.id for t in pieces_of("Ġ" + spelled(m[1]))]
                if m[2]:
                    ids += signs[m[2]] if m[2] in signs else signs.setdefault(m[2], [t.id for t in pieces_of(m[2])])
                out.append(ids)
            else:
                out.append(None)
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class PieceBpe:
    """Token ids and token bytes of a sentencepiece file that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
                      for i, name in enumerate(names)}
        self.one_by_one = all("▁" not in name.lstrip("▁") for name in names)
        plain = self.model.encode("a")
        self.blank = self.model.encode("a ")[len(plain):]

    def encode(self, segments: list[str]) -> list[list[int]]:
        got = self.model.encode([s[1:] for s in segments], num_threads=1)
        return [ids or self.blank for ids in got]  # only the lone space leaves nothing to encode


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token's row has a one at each of its bytes."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return ones(start, np.arange(start[-1]), int(start[-1]))


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, Csr, Csr]:
    """Ends of the groups, and tokens by groups for both sides, from token lengths that cover the same bytes."""
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    ended = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
    ended[end_a] = True
    ends = end_b[ended[end_b]]

    def of(end):
        return ones(np.arange(len(end) + 1), np.searchsorted(ends, end), len(ends))

    return ends, of(end_a), of(end_b)


class Spelling:
    """The bytes of many tokens at once."""

    def __init__(self, tokens: dict[int, bytes]):
        of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(x) for x in of])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(of), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.bytes[np.arange(int(size.sum())) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)]


def _strings(values: pa.Array, counts: np.ndarray, sign: str) -> pa.Array:
    """Stretches of ``values`` of the given lengths, joined."""
    return pc.binary_join(list_column(values, counts), sign)


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for many[0] places, then the same for the next."""
    return np.arange(int(many.sum())) + np.repeat(start - (np.cumsum(many) - many), many)


class Aligner:
    """Aligned segments by number, each distinct one aligned once while it is kept."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = [ByteBpe(a_path), PieceBpe(b_path)]
        self.spelling = [Spelling(side.bytes) for side in self.sides]
        self.known = Numbers()
        self.times_seen = np.zeros(0, np.int32)
        self.names = pa.array([], pa.string())
        self.counts = np.zeros((0, 6), np.int32)  # valid, tokens of a and of b, groups, links, shared
        self.pairs, self.times, self.many = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.pair_numbers = Interner()

    def _give_up_rare(self) -> None:
        keep = self.times_seen >= OFTEN
        kept = np.flatnonzero(keep)
        self.pairs, self.times = (x[np.repeat(keep, self.many)] for x in (self.pairs, self.times))
        self.counts, self.many, self.names = self.counts[kept], self.many[kept], self.names.take(pa.array(kept))
        to = (np.cumsum(keep) - 1).tolist()
        keep = keep.tolist()
        self.known = Numbers({s: to[i] for s, i in self.known.items() if keep[i]})
        self.times_seen = np.zeros(len(kept), np.int32)
        self.pair_numbers = Interner()

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text after its space, in bounded lists."""
        text, at = " " + text, 0
        if not self.sides[1].one_by_one:
            yield [text]
            return
        while at < len(text):
            to = CUT.search(text, at + LONG) if len(text) - at > LONG else None
            end = to.end() if to else len(text)
            yield SEGMENT.findall(text, at, end)
            at = end

    def number(self, segments: list[str]) -> np.ndarray:
        number, fresh = self.known.of(segments), self.known.fresh
        for at in range(0, len(fresh), FRESH):
            self._align(fresh[at:at + FRESH])
        self.known.fresh = []
        return number

    def _align(self, fresh: list[str]) -> None:
        total = len(fresh)
        raw, ends = utf8(pa.array(fresh, pa.large_string()))
        of, flat, size = [], [], []
        for side, spelling in zip(self.sides, self.spelling):
            ids = side.encode(fresh)
            of.append(np.repeat(np.arange(total), [len(x) for x in ids]))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, len(of[-1])))
            size.append(spelling.size[flat[-1]])
        length = np.diff(ends)
        good = np.logical_and(*(np.bincount(o, z, total) == length for o, z in zip(of, size)))
        place = np.repeat(np.arange(total), length)
        for k, spelling in enumerate(self.spelling):  # sides of equal length, byte by byte
            there = good[of[k]]
            wrong = spelling.spell(flat[k][there]) != raw[good[place]]
            good = good & (np.bincount(place[good[place]][wrong], minlength=total) == 0)
        for k in (0, 1):
            there = good[of[k]]
            of[k], flat[k], size[k] = of[k][there], flat[k][there], size[k][there]
        # all segments lie one after the other, and each ends a group
        group_ends, *group = groups_of(*size)
        group_of = np.searchsorted(np.cumsum(length * good), group_ends)
        n_groups = np.bincount(group_of, minlength=total)
        shared, segment, pair = np.zeros(total, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, block in product_blocks(incidence(size[0]), transposed(incidence(size[1]))):
            row = first + block.row_of()
            segment.append(of[0][row])
            pair.append(flat[0][row] << 32 | flat[1][block.column])
        for first, block in product_blocks(group[0], transposed(group[1])):
            shared += np.bincount(of[0][first + block.row_of()], minlength=total)
        segment, pair = np.concatenate(segment), np.concatenate(pair)
        links = np.bincount(segment, minlength=total)
        order = np.lexsort((pair, segment))
        segment, pair = segment[order], pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = (np.diff(segment) != 0) | (np.diff(pair) != 0)
        once = np.flatnonzero(new)
        said = [_strings(pa.array(ids).cast(pa.string()), np.bincount(g.column, minlength=len(group_ends)), ",") for ids, g in zip(flat, group)]
        names = _strings(pc.binary_join_element_wise(*said, "|"), n_groups, ";")
        self.names = pa.concat_arrays([self.names, names])
        counts = [good, np.bincount(of[0], minlength=total), np.bincount(of[1], minlength=total), n_groups, links, shared]
        self.counts = np.concatenate([self.counts, np.stack(counts, axis=1).astype(np.int32)])
        self.pairs = np.concatenate([self.pairs, pair[once]])
        self.times = np.concatenate([self.times, np.diff(np.append(once, len(pair))).astype(np.int32)])
        self.many = np.concatenate([self.many, np.bincount(segment[once], minlength=total)])
        self.times_seen = np.concatenate([self.times_seen, np.zeros(total, np.int32)])

    def texts(self, texts: list[str]):
        """Per text the five counts and the group listing; and its distinct pairs with their times and number.

        A text that one of the sides does not give back byte by byte has none of them.
        """
        if len(self.known) > KEPT:
            self._give_up_rare()
        number, count, waiting = [], [], []
        for text in texts:
            own = 0
            for some in self.segments(text) if text else ():
                waiting += some
                own += len(some)
                if len(waiting) > AT_ONCE:
                    number.append(self.number(waiting))
                    waiting = []
            count.append(own)
        number.append(self.number(waiting))
        number, text_of = np.concatenate(number), np.repeat(np.arange(len(texts)), count)
        self.times_seen += np.bincount(number, minlength=len(self.known)).astype(np.int32)
        bad = np.bincount(text_of[self.counts[number, 0] == 0], minlength=len(texts)) > 0
        number, text_of = number[~bad[text_of]], text_of[~bad[text_of]]
        totals = np.stack([np.bincount(text_of, self.counts[number, i], len(texts)).astype(np.int64) for i in range(1, 6)], axis=1)
        listing = _strings(self.names.take(pa.array(number)), np.bincount(text_of, minlength=len(texts)), ";")
        many = self.many[number]
        entry = _ranges((np.cumsum(self.many) - self.many)[number], many)
        name, _ = self.pair_numbers.number(self.pairs[entry].view(np.uint64))
        width = len(self.pair_numbers) + 1
        key, where = np.unique(np.repeat(text_of, many) * width + name, return_inverse=True)
        times = np.bincount(where, self.times[entry], len(key)).astype(np.int32)
        return totals, listing, signed(self.pair_numbers.keys)[key % width], times, np.bincount(key // width, minlength=len(texts))


def _aligner(kept, a_path: str, b_path: str):
    """``kept``: a broadcast of an empty dict, of which each Python worker holds one copy for all its tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept.value.get("aligner") or kept.value.setdefault("aligner", Aligner(a_path, b_path))
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                totals, listing, pairs, times, per = aligner.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *(pa.array(totals[:, i]) for i in range(5)), listing,
                     list_column(pa.array(pairs), per), list_column(pa.array(times), per)],
                    names=["row", "doc_id", *COUNTS, "groups", "pairs", "times"])
    return run


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups, pairs, times: one row per row of ``docs``.

    ``a_path`` is a byte-level BPE file that reads a space and the text, ``b_path`` a
    sentencepiece file that adds the space itself. Byte offsets where tokens of both end cut the
    tokens into groups, listed as ``a1,a2|b1;a3|b2,b3``. Links are the token pairs with a byte in
    common (the non-zeros of token-byte incidence A times B transposed), shared ones those in one
    group (the same of token-group incidence). ``pairs`` holds each linked id pair of the text
    once, a * 2^32 + b, and ``times`` its number of links.

    A text that is null or empty, or that one side does not give back byte by byte, has no
    tokens: zeros and empty lists. A null doc_id keeps its row; repeated rows are aligned each;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = docs.sparkSession.sparkContext.broadcast({})
    return rows.mapInArrow(_aligner(kept, a_path, b_path), "row long, doc_id long, " + "".join(f"{c} long, " for c in COUNTS)
                           + "groups string, pairs array<long>, times array<int>")


def _head_sums(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, documents, best = head.value
        for batch in batches:
            keys, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            size = np.diff(batch.column("pairs").offsets.to_numpy())
            text = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
            hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], text[hit], (times * best[at])[hit] if len(pair) else [])
            np.add.at(sums[1], text[hit], (times * documents[at])[hit] if len(pair) else [])
            rest = np.bincount(text[~hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *map(pa.array, sums), list_column(pa.array(keys[~hit]), rest), list_column(pa.array(times[~hit]), rest)],
                names=["row", "head_best", "head_sum", "pairs", "times"])
    return run


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, documents, best: in how many rows each linked id pair stands, and whether that is the most of its A id."""
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return cut(counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best")), "weights")


def weighed(table: DataFrame) -> DataFrame:
    """``table`` without pairs and times, with n_best and count_sum; ``table`` is what ``aligned`` gave, written down.

    The pairs found in the most documents, at most ``HEAD``, go to every task; what is left of
    a document's pairs is joined to the counts, no key of which stands in more documents than
    the least of those.
    """
    counts = pair_counts(table)
    sizes = sorted(counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("e")).count().collect(), reverse=True)
    total, least = 0, 63
    for size in sizes:  # one row per power of two
        total += size["count"]
        if total > HEAD:
            break
        least = size["e"]
    held = counts.filter(F.floor(F.log2("documents")) >= least)
    top = held.toArrow().sort_by("pair")
    head = table.sparkSession.sparkContext.broadcast(
        (top["pair"].to_numpy(), top["documents"].to_numpy(), top["best"].to_numpy(zero_copy_only=False).astype(np.int64)))
    found = cut(table.select("row", "pairs", "times").mapInArrow(
        _head_sums(head), "row long, head_best long, head_sum long, pairs array<long>, times array<long>"), "links")
    rare = (found.filter("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("rare_best"), F.sum(F.col("times") * F.col("documents")).alias("rare_sum")))

    def both(head, rest):
        return F.col(head) + F.coalesce(rest, F.lit(0).cast("long"))

    sums = found.join(rare, "row", "left").select("row", both("head_best", "rare_best").alias("n_best"), both("head_sum", "rare_sum").alias("count_sum"))
    return table.drop("pairs", "times").join(sums, "row")
