"""What the criteria of text quality are made of, counted in one pass over the code points of a batch of texts.

Each code point has its classes in a table; runs of letters and digits are words, runs of those and dashes are dashed words. Lengths are in UTF-16 units.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import WS

#: Letters that the criteria count as Lithuanian (fixed values; they leave out one letter with its capital).
LITHUANIAN = "ąčęėįšūžĄČĘĖĮŠŪŽ"
CAPITALS = "A-ZĄČĘĖĮŠŲŪŽ"
JUNK = r"[@#$%^&*_=+\[\]{}|~<>]"

#: size: UTF-16 units; chars, numbers, foreign, lithuanian: those of words, all, numeric ones, beyond ASCII and Lithuanian letters; count: words, one in a text without;
#: junk, marks: characters; upper: words that begin with a capital; over1 to over20: words of more units; inner: with a capital of CAPITALS neither first nor last;
#: dashed2: dashed words of more than two units; digits: words that no dash touches, with one or two digits 0 to 9, one of them neither first nor last; filled: 1 if
#: there is more than white space.
NAMES = ("size", "chars", "count", "numbers", "foreign", "lithuanian", "junk", "marks", "upper", "over1", "over2", "over3", "over20", "inner", "dashed2", "digits", "filled")
WORD, NUMBER, FOREIGN, UPPER, CAPITAL, LETTER_LT, JUNK_SIGN, MARK, DIGIT, DASH, SPACE = (1 << k for k in range(11))
#: Classes by pattern; the others go by Unicode's categories.
PATTERNS = {CAPITAL: f"[{CAPITALS}]", LETTER_LT: f"[{LITHUANIAN}]", JUNK_SIGN: JUNK, MARK: "[.!?]", DIGIT: "[0-9]", DASH: "[–—-]", SPACE: f"[{WS}]"}
#: Bytes of text that are looked at together, so that what is made of them stays in a core's cache; a longer text is parted at spaces.
PIECE = 1 << 18
BLANK = re.compile(b" ")


def category_classes(c: str) -> int:
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return 0
    return WORD | NUMBER * (kind[0] == "N") | FOREIGN * (c > "\x7f") | UPPER * (kind == "Lu" and c <= "\uffff")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The classes of the Basic Multilingual Plane."""
    every = "".join(map(chr, range(0x10000)))
    table = np.array([category_classes(c) for c in every], np.uint16)
    for bit, pattern in PATTERNS.items():
        table[[m.start() for m in re.finditer(pattern, every)]] |= bit
    return table


def classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of code points, and where there are some beyond the Basic Multilingual Plane."""
    if codes.dtype == np.uint8 or not (codes > 0xFFFF).any():
        return class_table()[codes], np.empty(0, np.int64)
    far = np.flatnonzero(codes > 0xFFFF)
    kind = class_table()[np.minimum(codes, 0xFFFF)]
    known, which = np.unique(codes[far], return_inverse=True)
    kind[far] = np.array([category_classes(chr(c)) for c in known], np.uint16)[which]
    return kind, far


def code_points(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts that stand in raw between offsets, and the offsets in them."""
    if raw.isascii():
        return np.frombuffer(raw, np.uint8), offsets
    try:
        text = raw.decode()
        bounds = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), offsets)
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace") for a, b in pairwise(offsets)]
        text, bounds = "".join(texts), np.cumsum([0, *map(len, texts)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), bounds


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end; none goes beyond a bound."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = bounds[bounds < len(inside)], bounds[bounds > 0] - 1
    first[starts], last[ends] = inside[starts], inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def piece_counts(raw: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of texts that stand in raw between offsets; what is no sum is left to the whole text."""
    codes, bounds = code_points(raw, offsets)
    kind, far = classes(codes)
    of = lambda bits: kind & bits != 0
    at = lambda bits: np.flatnonzero(of(bits))
    rows = lambda places: np.diff(np.searchsorted(places, bounds))
    far_words = far[of(WORD)[far]]

    def units(starts, ends):
        return ends - starts + (np.searchsorted(far_words, ends) - np.searchsorted(far_words, starts) if len(far_words) else 0)

    def twice(bits):  # those beyond the plane are two
        return rows(at(bits)) + (rows(far[of(bits)[far]]) if len(far) else 0)

    starts, ends = runs(of(WORD), bounds)
    long = units(starts, ends)
    out = {"size": np.diff(bounds) + rows(far), "chars": twice(WORD), "count": rows(starts), "numbers": twice(NUMBER), "foreign": twice(FOREIGN)}
    out |= {"lithuanian": rows(at(LETTER_LT)), "junk": rows(at(JUNK_SIGN)), "marks": rows(at(MARK)), "upper": rows(starts[of(UPPER)[starts]])}
    out |= {f"over{k}": rows(starts[long > k]) for k in (1, 2, 3, 20)}

    def words_of(places):  # the word of each place, and whether the place is neither its first nor its last
        word = np.searchsorted(starts, places, "right") - 1
        return word, (places > starts[word]) & (places < ends[word] - 1)

    word, within = words_of(at(CAPITAL))
    out["inner"] = rows(starts[np.unique(word[within])])
    word, within = words_of(at(DIGIT))
    digits, inner = (np.bincount(w, minlength=len(starts)) for w in (word, word[within]))
    found = np.flatnonzero((digits > 0) & (digits < 3) & (inner > 0))
    out["dashed2"] = out["over2"]
    if of(DASH).any():
        dashed, dashed_ends = runs(of(WORD | DASH), bounds)
        out["dashed2"] = rows(dashed[units(dashed, dashed_ends) > 2])
        whole = np.searchsorted(dashed, starts[found], "right") - 1
        found = found[(dashed[whole] == starts[found]) & (dashed_ends[whole] == ends[found])]
    out["digits"] = rows(starts[found])
    out["filled"] = np.diff(bounds) - rows(at(SPACE))
    return out


def pieces(raw: memoryview, offsets: np.ndarray):
    """(start, end) of pieces: whole texts together, or parts of one that is longer, which end where a space is."""
    start, stop = int(offsets[0]), int(offsets[-1])
    while start < stop:
        end = int(offsets[np.searchsorted(offsets, start + PIECE, "right") - 1])
        if end <= start:
            whole = int(offsets[np.searchsorted(offsets, start, "right")])
            space = BLANK.search(raw, min(start + PIECE, whole), whole)
            end = space.start() if space else whole
        yield start, end
        start = end


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in NAMES]))
def text_counts(texts: pa.Array) -> pa.Array:
    """A struct of the counts of each text, null for a null text."""
    own = texts.cast(pa.large_string())
    _, places, data = own.buffers()
    out = np.zeros((len(NAMES), len(own)))
    if len(own) and data is not None:
        offsets, raw = np.frombuffer(places, np.int64)[own.offset : own.offset + len(own) + 1], memoryview(data)
        for start, end in pieces(raw, offsets):
            low, high = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end, "left")
            found = piece_counts(bytes(raw[start:end]), np.clip(offsets[low : high + 1], start, end) - start)
            out[:, low:high] += [found[k] for k in NAMES]
    by = dict(zip(NAMES, out))
    by |= {"count": np.maximum(by["count"], 1), "filled": np.minimum(by["filled"], 1)}
    return pa.StructArray.from_arrays([pa.array(by[k]) for k in NAMES], NAMES, mask=own.is_null())
