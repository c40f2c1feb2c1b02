"""One large text file read by many tasks although its records are no lines.

Spark cuts a file into blocks at a mark (line feeds for delimited text, commas for JSON). A mark
inside quotes ends no record, and whether it is inside depends on all that stands before. So each
block is first read for every state it may start in; a block's summary says which state it ends
in. The summaries, a few numbers per block, are put in order and give each block's true start,
as well as the number of records before it. Then every block cuts its own records. A record that
goes on over the end of a block leaves parts, which alone are shuffled and joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "pos bigint, head boolean, value string"
_PARTS = "pos bigint, head boolean, block bigint, whole boolean, value string"


def fragments(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """The text between marks, with the file and the block it starts in."""
    return spark.read.option("lineSep", mark).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def runs_of_blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The stretches of a batch that lie in one block, in order."""
    start = batch.column("start").to_numpy()
    file = pc.run_end_encode(batch.column("file"))
    ends = set(file.run_ends.to_pylist()) | set((np.flatnonzero(np.diff(start)) + 1).tolist())
    at = 0
    for to in sorted(ends):
        yield (batch.column("file")[at].as_py(), int(start[at])), batch.column("value").slice(at, to - at)
        at = to


def _summaries(new, schema: str) -> Callable:
    """Feed each block's fragments, in order, to a summary made by ``new``; one row per block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, summary, rows = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            for block, values in runs_of_blocks(batch):
                if block != key:
                    rows += [(*key, *summary.result())] if key else []
                    key, summary = block, new(block)
                summary.feed(values)
        rows += [(*key, *summary.result())] if key else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["file", "start", *names])
    return run


def _per_block(pieces: DataFrame, new, schema: str) -> list:
    """Summaries of all blocks in file order: metadata, like the list of blocks that Spark plans a scan from."""
    rows = pieces.mapInArrow(_summaries(new, schema), f"file string, start bigint, {schema}").collect()
    return sorted(rows, key=lambda r: (r["file"], r["start"]))


def _joined(parts: DataFrame, mark: str) -> DataFrame:
    """Whole records as they are, and the parts of the others joined in block order."""
    open_parts = parts.filter("not whole").groupBy("pos", "head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), mark).alias("value"))
    return parts.filter("whole").select("pos", "head", "value").unionByName(open_parts)


def _cut(pieces: DataFrame, cutter, plan: dict, mark: str) -> DataFrame:
    """Every block's records; ``plan`` holds each block's start and travels to all tasks."""
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for block, values in runs_of_blocks(batch):
                if block != key:
                    out += state.close() if state else []
                    key, state = block, cutter(*shared.value[block]) if block in shared.value else None
                if state:
                    out += state.feed(values)
            if out:
                yield _rows(out)
        if state and (out := state.close()):
            yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["pos", "head", "block", "whole", "value"])

    return _joined(pieces.mapInArrow(run, _PARTS), mark)


# --- Delimited text ------------------------------------------------------------------------


class Quotes:
    """Whether a line of delimited text ends inside a quoted field."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        body = r'[^"]*+(?:""[^"]*+)*+'
        self.opened = re.compile(rf'(?s)(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{body}\Z')
        self.closing = re.compile(rf'(?s){body}"[^{s}]*+({s}|\Z)')

    def after(self, line: str, inside: bool) -> bool:
        """State at the end of ``line``, which starts inside quotes or at the start of a field."""
        if not inside:
            return self.opened.match(line) is not None
        end = self.closing.match(line)
        return True if end is None else bool(end.group(1)) and self.opened.match(line, end.end()) is not None


def _lines(fragment: str) -> list[str]:
    """A fragment between line feeds as lines: a carriage return ends one too, and leaves an empty one behind it."""
    return fragment.split("\r")


class _Lines:
    """For both states a block may start in: the state it ends in, and the records that start in it."""

    def __init__(self, quotes: Quotes):
        self.quotes, self.inside, self.count = quotes, [False, True], [0, 0]

    def feed(self, values: pa.Array) -> None:
        marked = np.flatnonzero(pc.match_substring_regex(values, '(?s)"|\\r.').to_numpy(zero_copy_only=False))
        filled = ~pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(filled)])
        at = 0
        for i in [*marked.tolist(), len(values)]:  # the lines between stay in their state
            for e in (0, 1):
                self.count[e] += 0 if self.inside[e] else int(upto[i] - upto[at])
            for line in _lines(values[i].as_py()) if i < len(values) else ():
                for e in (0, 1):
                    self.count[e] += not self.inside[e] and line != ""
                self.inside = [self.quotes.after(line, s) for s in self.inside]
            at = i + 1

    def result(self):
        return (*self.inside, *self.count)


class _Records:
    """Cuts one block of lines into records.

    ``before`` records of all files stand before the block, ``of_file`` before its file, the
    ``file``-th of all; the first record of each file is its head.
    """

    def __init__(self, quotes: Quotes, number: int, inside: bool, before: int, of_file: int, file: int):
        self.quotes, self.number, self.inside, self.next = quotes, number, inside, before
        self.of_file, self.file = of_file, file
        self.text: list[str] = []  # lines and what ends them
        self.continued = inside

    def _record(self, ended: bool) -> tuple:
        at, text = self.next - 1, "".join(self.text[:-1])
        self.text = []
        head, whole = at == self.of_file, ended and not self.continued
        self.continued = False
        return self.file if head else at - self.file - 1, head, self.number, whole, text

    def feed(self, values: pa.Array) -> list:
        out = []
        for fragment in values.to_pylist():
            lines = _lines(fragment)
            for i, line in enumerate(lines):
                if not self.inside:
                    if line == "":
                        continue
                    self.next += 1
                self.text += (line, "\n" if i == len(lines) - 1 else "\r")
                self.inside = self.quotes.after(line, self.inside) if '"' in line else self.inside
                if not self.inside:
                    out.append(self._record(True))
        return out

    def close(self) -> list:
        return [self._record(False)] if self.text else []


def has_open_lines(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether some line ends inside quotes, so that records are not lines. Lines without quotes are not looked at."""
    quotes = Quotes(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [True for v in batch.column("value").to_pylist() for line in _lines(v) if quotes.after(line, False)][:1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.bool_())], names=["open"])

    quoted = spark.read.option("lineSep", "\n").text(path).filter(F.contains("value", F.lit('"')))
    return bool(quoted.mapInArrow(run, "open boolean").head(1))


def line_states(spark: SparkSession, path: str, sep: str) -> list:
    """Of every block, for both starts: whether it ends inside quotes, and the records that start in it."""
    return _per_block(fragments(spark, path, "\n"), lambda _: _Lines(Quotes(sep)),
                      "out boolean, within boolean, n_out bigint, n_within bigint")


def delimited_records(spark: SparkSession, path: str, sep: str, states: list | None = None) -> DataFrame:
    """pos, head, value: the records of headed delimited files with their place over all files, from 0.

    Records end at line feeds and carriage returns outside quotes; empty lines are none. The first record of each file is its head, with the file's place.
    """
    plan, before, of_file, file, inside, last = {}, 0, 0, -1, False, None
    for number, s in enumerate(states if states is not None else line_states(spark, path, sep)):
        if s["file"] != last:
            inside, of_file, file, last = False, before, file + 1, s["file"]
        plan[s["file"], s["start"]] = (number, inside, before, of_file, file)
        before += s["n_within"] if inside else s["n_out"]
        inside = s["within"] if inside else s["out"]
    quotes = Quotes(sep)
    return _cut(fragments(spark, path, "\n"), lambda *start: _Records(quotes, *start), plan, "\n")


# --- JSON ------------------------------------------------------------------------------------

QUOTE, SLASH, BLANKS = 34, 92, [32, 9, 10, 13]


def _signs(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all fragments, the end of each, and at each byte the unescaped quotes up to and with it."""
    values = values.cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(values).to_numpy())
    data = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
    plain = np.where(data != SLASH, np.arange(len(data)), -1)
    if len(ends):
        first = ends[:-1][ends[:-1] < len(data)]
        plain[first] = np.maximum(plain[first], first - 1)  # a mark stands before
    slashes = np.arange(len(data)) - 1 - np.concatenate([[-1], np.maximum.accumulate(plain)[:-1]]) if len(data) else plain
    return data, ends, np.cumsum((data == QUOTE) & (slashes % 2 == 0))


def _steps(data: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """How each byte outside quotes changes the depth."""
    up, down = (data == ord("[")) | (data == ord("{")), (data == ord("]")) | (data == ord("}"))
    return (up.astype(np.int64) - down) * ~quoted


class _Depths:
    """For both states a block may start in: how far the depth moves, and whether quotes are open at the end."""

    def __init__(self):
        self.odd, self.moves, self.first = False, [0, 0], -1

    def feed(self, values: pa.Array) -> None:
        data, _, quotes = _signs(values)
        if not len(data):
            return
        ink = data[~np.isin(data, BLANKS)] if self.first < 0 else data[:0]
        self.first = int(ink[0]) if len(ink) else self.first
        quoted = (quotes + self.odd) % 2 == 1
        for e in (0, 1):
            self.moves[e] += int(_steps(data, quoted ^ bool(e)).sum())
        self.odd ^= bool(quotes[-1] % 2)

    def result(self):
        return self.odd, *self.moves, self.first


class _Lists:
    """Where in a block the wanted list opens and where it, or one opened before, closes.

    At depth ``level`` - 1 stands the document (an object) or nothing; a list there is wanted if
    it holds something or ``strict`` is false. Places are bytes of the block without marks.
    """

    def __init__(self, strict: bool, quoted: bool, depth: int, level: int):
        self.strict, self.odd, self.depth, self.level, self.at = strict, quoted, depth, level, 0
        self.opened = self.closed = self.closed_before = -1
        self.commas = self.commas_before = 0

    def feed(self, values: pa.Array) -> None:
        data, ends, quotes = _signs(values)
        quoted = (quotes + self.odd) % 2 == 1
        steps = _steps(data, quoted)
        depth = self.depth + np.cumsum(steps)
        bounds = self.at + ends[~np.concatenate([[self.odd], quoted])[ends] & (np.concatenate([[self.depth], depth])[ends] == self.level)]
        closing = np.flatnonzero((steps < 0) & (depth == self.level - 1))
        if self.closed_before < 0 and len(closing):
            self.closed_before = self.at + int(closing[0])
        if self.opened < 0:
            opening = np.flatnonzero((steps > 0) & (depth == self.level) & (data == ord("[")))
            if self.strict and len(opening):
                ink = np.flatnonzero(~np.isin(data, BLANKS))
                follow = np.searchsorted(ink, opening, "right")
                empty = data[ink[np.minimum(follow, len(ink) - 1)]] == ord("]")
                opening = opening[~empty | (follow == len(ink))]
            if len(opening):
                self.opened = self.at + int(opening[0])
        if self.opened >= 0 and self.closed < 0:
            after = closing[self.at + closing > self.opened]
            if len(after):
                self.closed = self.at + int(after[0])
        self.commas_before += int((bounds <= _or_end(self.closed_before)).sum())
        if self.opened >= 0:
            self.commas += int(((bounds > self.opened) & (bounds <= _or_end(self.closed))).sum())
        self.at += len(data)
        if len(data):
            self.depth, self.odd = int(depth[-1]), self.odd ^ bool(quotes[-1] % 2)

    def result(self):
        return self.opened, self.closed, self.closed_before, self.commas, self.commas_before


class _Elements:
    """Cuts the part of a block that lies in the list (bytes ``a`` to ``b``) at its commas.

    ``before`` elements of all files end before the block.
    """

    def __init__(self, number: int, quoted: bool, depth: int, level: int, a: int, b: int, before: int):
        self.number, self.odd, self.depth, self.level, self.a, self.b, self.next = number, quoted, depth, level, a, b, before
        self.at, self.text = 0, []
        self.continued = a < 0 and (quoted or depth != level)

    def feed(self, values: pa.Array) -> list:
        data, ends, quotes = _signs(values)
        quoted = (quotes + self.odd) % 2 == 1
        depth = self.depth + np.cumsum(_steps(data, quoted))
        bound = ~np.concatenate([[self.odd], quoted])[ends] & (np.concatenate([[self.depth], depth])[ends] == self.level)
        out = []
        for text, end, at_bound in zip(values.cast(pa.binary()).to_pylist(), ends.tolist(), bound.tolist()):
            start, end = self.at + end - len(text), self.at + end
            if end <= self.a or start > self.b:
                continue
            self.text.append(text[max(0, self.a + 1 - start):max(0, min(end, self.b) - start)])
            if end > self.b or at_bound:
                out.append(self._element(True))
                self.next += 1
        if len(data):
            self.depth, self.odd = int(depth[-1]), self.odd ^ bool(quotes[-1] % 2)
        self.at += len(data)
        return out

    def _element(self, ended: bool) -> tuple:
        text, self.text = b",".join(self.text).decode(), []
        whole, self.continued = ended and not self.continued, False
        return self.next, False, self.number, whole, text

    def close(self) -> list:
        return [self._element(False)] if self.text else []


NEVER = 1 << 62


def _or_end(place: int) -> int:
    return NEVER if place < 0 else place


def json_elements(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """pos, value: the records of JSON documents, one document per file, as JSON texts on one line, in order.

    A list gives its elements; an object those of its first list in document order, else itself.
    ``strict`` (candidate files): the list must not be empty and an object is no record.
    """
    pieces = fragments(spark, path, ",")
    depths = _per_block(pieces, lambda _: _Depths(), "odd boolean, m_out bigint, m_within bigint, first bigint")
    starts, last, quoted, depth, level = {}, None, False, 0, 0
    for s in depths:
        if s["file"] != last:
            quoted, depth, level, last = False, 0, 1 if s["first"] == ord("[") else 2, s["file"]
        starts[s["file"], s["start"]] = (quoted, depth, level)
        depth += s["m_within"] if quoted else s["m_out"]
        quoted ^= s["odd"]
    shared = spark.sparkContext.broadcast(starts)
    lists = _per_block(pieces, lambda block: _Lists(strict, *shared.value[block]),
                       "opened bigint, closed bigint, closed_before bigint, commas bigint, commas_before bigint")
    plan, before, files = {}, 0, {}
    for number, s in enumerate(lists):
        files.setdefault(s["file"], []).append((number, s))
    for file, blocks in files.items():
        opened, open_list = False, False
        for number, s in blocks:
            start = starts[file, s["start"]]
            if open_list:
                plan[file, s["start"]] = (number, *start, -1, _or_end(s["closed_before"]), before)
                open_list, before = s["closed_before"] < 0, before + s["commas_before"]
            elif s["opened"] >= 0 and not opened:
                plan[file, s["start"]] = (number, *start, s["opened"], _or_end(s["closed"]), before)
                opened, open_list, before = True, s["closed"] < 0, before + s["commas"]
        if not opened and not strict:  # an object without a list is one record, cut nowhere
            plan |= {(file, s["start"]): (number, *starts[file, s["start"]][:2], 0, -1, NEVER, before) for number, s in blocks}
        before += 1
    out = _cut(pieces, lambda *start: _Elements(*start), plan, ",")
    flat = F.trim(F.regexp_replace("value", r"[\r\n\t]+", " "))
    return out.select("pos", flat.alias("value")).filter("value <> ''")
