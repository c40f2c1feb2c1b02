"""Byte-level BPE pre-tokens of many texts at once.

A pre-token is what the tokenizer's ``ByteLevel`` splitter gives: a contraction, a run of
letters, digits or other signs with the blank before it, or white space. The class of every
character is asked of the tokenizer library itself, so no Unicode version can differ; the
places of all pre-tokens of a piece of text then follow from array operations.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tablescout.llm.texts import BASE, KeyTable, mix

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 255


class Splitter:
    """Splits texts the way one tokenizer file does.

    Broadcast, a Python worker opens the file once and keeps what it learned from task to task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        if kind != "ByteLevel" or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def __reduce__(self):
        return Splitter, (self.path,)

    def _learn(self, codes: np.ndarray) -> None:
        for code in codes:
            c = chr(code)
            spans = [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}!")]
            ends = {b for _, b in spans}
            if c == " ":
                kind = SPACE  # the blank that joins what follows
            elif 1 not in ends:
                kind = LETTER
            elif 2 not in ends:
                kind = DIGIT
            elif 4 in ends:
                kind = SPACE
            else:
                kind = OTHER
            self.kinds[code] = kind

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings, the row of each part, the special id after it or -1."""
        if not self.special or not any(s in t for t in texts for s in self.special):
            return texts, np.arange(len(texts)), np.full(len(texts), -1)
        parts, row, after = [], [], []
        for i, text in enumerate(texts):
            cut = self.at_special.split(text)
            for j in range(0, len(cut), 2):
                parts.append(cut[j])
                row.append(i)
                after.append(self.special[cut[j + 1]] if j + 1 < len(cut) else -1)
        return parts, np.array(row, np.int64), np.array(after, np.int64)

    def split(self, parts: list[str]):
        """Code points, start, end and hash of every pre-token, and each part's first one."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        size = len(codes)
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        kind = self.kinds[codes]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(codes[kind == UNKNOWN]))
            kind = self.kinds[codes]
        edge = np.zeros(size + 1, bool)
        edge[offs] = True
        begin = edge[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # white space gives its last character away when something follows in the same text
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]) if size else np.zeros(0, np.int64)
        begin[last] = True
        blank = last[codes[last] == 32]
        begin[blank + 1] = False
        # contractions start at an apostrophe that begins its own run
        mark = np.flatnonzero((codes[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~edge[1:-1]) if size else np.zeros(0, np.int64)
        if len(mark):
            end_of = np.append(codes, np.zeros(2, np.uint32))
            same = np.append(~edge[1:], [False, False])
            one, two = end_of[mark + 1], end_of[mark + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = same[mark + 1] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, n in ((short, 2), (long & ~short, 3)):
                at = mark[hit]
                begin[at + 1] = False
                stop = at + n
                begin[stop[stop < size]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], size) if len(start) else start
        power = np.full(size, BASE, np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        back[:1] = 1
        np.cumprod(back, out=back)
        value = mix((total[end] - total[start]) * back[start]) if len(start) else np.zeros(0, np.uint64)
        return codes, start, end, value, np.searchsorted(start, offs)


def byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 signs for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Latin letters, the same in any Unicode version and each one sign of its own, and ASCII signs behind them but apostrophes.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:-@\[-`{-~]*)")
_SIGNS = byte_signs()


def spelled(word: str) -> str:
    """The bytes of a word in the signs of a byte-level vocabulary."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SIGNS)


def texts_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The texts of many spans, all code points decoded at once."""
    whole = codes.tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


class Numbers(dict):
    """Numbers things in order of first sight; ``fresh`` are those seen since it was last emptied."""

    def __init__(self, *known):
        super().__init__(*known)
        self.fresh = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def of(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), np.int64, len(things))


class Interner:
    """Numbers 64-bit keys in order of first sight, many at a time."""

    def __init__(self):
        self.old, self.new = KeyTable(np.zeros(0, np.uint64)), KeyTable(np.zeros(0, np.uint64))

    def __len__(self) -> int:
        return len(self.old.keys) + len(self.new.keys)

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([self.old.keys, self.new.keys])

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key, and the places where keys were seen for the first time."""
        out = self.old.find(keys)
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            return out, rest
        got = self.new.find(keys[rest])
        base = len(self.old.keys)
        out[rest] = np.where(got >= 0, got + base, -1)
        rest = rest[got < 0]
        if not len(rest):
            return out, rest
        fresh, first, inverse = np.unique(keys[rest], return_index=True, return_inverse=True)
        out[rest] = base + len(self.new.keys) + inverse
        self.new = KeyTable(np.concatenate([self.new.keys, fresh]))
        if len(self.new.keys) > max(20_000, base // 2):
            self.old, self.new = KeyTable(self.keys), KeyTable(np.zeros(0, np.uint64))
        return out, rest[first]
