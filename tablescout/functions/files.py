"""Opening landed files inside tasks. A file that cannot be read gives its reason, never an error."""

from __future__ import annotations

import csv
import gzip
import io
import json
import sys
import zipfile
import zlib
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tablescout.functions import fixed_values as fv


def suffix(name: str) -> str:
    return PurePosixPath(name.split("?")[0].split("#")[0]).suffix.lower()


UNPACKED_BYTES = 512 << 20  # a file that unpacks to more is not read in a task


class TooLarge(ValueError):
    pass


def _read(source, limit: int) -> bytes:
    raw = source.read(limit + 1)
    if len(raw) > limit:
        raise TooLarge
    return raw


def unpack(name: str, raw: bytes, limit: int = UNPACKED_BYTES) -> tuple[str, bytes | None, str]:
    """The innermost file of an archive: (member name, bytes, error). No more than ``limit`` bytes are unpacked."""
    seen = set()
    while True:
        is_zip = suffix(name) == ".zip" or raw[:4] == b"PK\x03\x04"
        is_gz = suffix(name) == ".gz" or raw[:2] == b"\x1f\x8b"
        if not (is_zip or is_gz):
            return name, raw, ""
        mark = len(raw), zlib.crc32(raw)
        if mark in seen:
            return name, None, "archive holds itself"
        seen.add(mark)
        try:
            if is_zip:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    name = first_table(z.namelist())
                    if not name:
                        return "", None, "zip contains no tabular files"
                    with z.open(name) as member:
                        raw = _read(member, limit)
            else:
                with gzip.open(io.BytesIO(raw)) as member:
                    raw = _read(member, limit)
                name = name[:-3] if name.lower().endswith(".gz") else name
        except TooLarge:
            return name, None, f"unpacked file exceeds {limit // (1024 * 1024)} MB"
        except zipfile.BadZipFile:
            return name, None, "not a valid ZIP file"
        except (OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zlib.error) as e:
            return name, None, f"decompression error: {e}"


def first_table(names: list[str]) -> str:
    """The member to read: by kind of file, then by place; hidden paths do not count."""
    visible = [n for n in names if not any(
        p.startswith(("__", ".")) for p in PurePosixPath(n).parts)]
    known = [n for n in visible if suffix(n) in fv.TABULAR_EXT]
    return min(known, key=lambda n: fv.TABULAR_EXT.index(suffix(n)), default="")


def charset(raw: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "iso-8859-1"


def delimited(text: str, sep: str):
    """Header and rows, or None when a row is wider than the header or there is no header."""
    csv.field_size_limit(sys.maxsize)  # a long field is no reason to lose a file
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    if not rows or any(len(r) > len(rows[0]) for r in rows):
        return None
    return rows[0], rows[1:]


def records(items: list):
    """Header and rows of JSON records; nested values stay JSON texts."""
    header: dict[str, None] = {}
    for r in items:
        header.update(dict.fromkeys(r if isinstance(r, dict) else {"0": None}))

    def text(v):
        if v is None or isinstance(v, str):
            return v
        # dates, decimals and bytes of typed files are texts of their own
        return json.dumps(v, default=str) if isinstance(v, (dict, list, bool, int, float)) else str(v)
    return list(header), [[text(r.get(h) if isinstance(r, dict) else r) for h in header] for r in items]


def json_table(text: str):
    doc = json.loads(text)
    if isinstance(doc, list):
        return records(doc)
    if isinstance(doc, dict):
        for v in doc.values():
            if isinstance(v, list) and v:
                return records(v)
    return None


def parse(name: str, raw: bytes):
    """(header, rows, error) of one unpacked file."""
    ext = suffix(name)
    if ext in (".xls", ".xlsx"):
        return None, None, "spreadsheets are not read"
    try:
        if ext == ".parquet":
            t = pq.read_table(io.BytesIO(raw)).to_pylist()
            found = records(t)
        elif ext == ".json":
            found = json_table(raw.decode(charset(raw), errors="replace"))
        else:
            text = raw.decode(charset(raw), errors="replace")
            first = {".tsv": ["\t"], ".txt": []}.get(ext, [","])
            more = {".tsv": [], ".txt": [",", "\t", ";", "|"]}.get(ext, ["\t", ";", "|"])
            found = next(filter(None, (delimited(text, s) for s in first)), None)
            wide = (delimited(text, s) for s in more)
            found = found or next((f for f in wide if f and len(f[0]) > 1), None)
            if found:  # only delimited text spells missing values out
                found = found[0], [[None if v in fv.NA_TOKENS else v for v in r] for r in found[1]]
    except (ValueError, csv.Error, OSError, RecursionError) as e:
        return None, None, f"parse error: {e}"
    if not found:
        return None, None, "could not parse as tabular data"
    return *found, ""


CELL_COLUMNS = ["url", "member", "row_id", "col_pos", "col", "value", "error"]
FRAME_ROWS = 50000


def cells_of(url: str, raw: bytes):
    """Cells of one file: (url, member, row_id, col_pos, col, value, error)."""
    member, data, error = unpack(url, raw)
    header = rows = None
    if data is not None:
        header, rows, error = parse(member, data)
    if not error and len(header) < 2:
        error = f"only {len(header)} column(s)"
    elif not error and not rows:
        error = "empty table"
    if error:
        yield url, member, None, None, None, None, error
        return
    for i, row in enumerate(rows):
        for j, h in enumerate(header):
            v = row[j] if j < len(row) else None
            yield url, member, i, j, str(h), v, ""


def file_cells(batches):
    """Cells of landed files in frames of bounded size, many small files to a frame.

    A file that gives no usable table has one row with its error.
    """
    held = []
    for pdf in batches:
        for url, raw in zip(pdf["url"], pdf["content"]):
            for cell in cells_of(url, bytes(raw)):
                held.append(cell)
                if len(held) >= FRAME_ROWS:
                    yield pd.DataFrame(held, columns=CELL_COLUMNS)
                    held = []
    if held:
        yield pd.DataFrame(held, columns=CELL_COLUMNS)


FRAME_BYTES = 4 << 20  # unpacked bytes gathered before they are handed on; one larger file goes alone
MEMBERS = pa.schema([("url", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def framed(rows, schema: pa.Schema, size):
    """Record batches of ``rows`` that hold about ``FRAME_BYTES`` by ``size``, whatever a batch before them held."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= FRAME_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def unpacked(batches):
    """Archive members: (url, member, content, error), in frames of bounded size."""
    for batch in batches:
        files = ((url.as_py(), raw.as_py()) for url, raw in zip(batch.column("url"), batch.column("content")))
        yield from framed(((url, *unpack(url, raw)) for url, raw in files), MEMBERS, lambda row: len(row[2] or b""))
