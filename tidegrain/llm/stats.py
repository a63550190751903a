"""Statistics of whole texts, counted with numpy on the UTF-8 bytes of Arrow slices.

Words are runs of bytes other than space and 0x09-0x0D. Equal lines, words and word windows are told by 64-bit hashes: sums of
random byte codes times powers of an odd number, scaled back to the start of the run.

Defined results: a null or empty text has all counts 0; very long texts are counted whole; repeated rows give repeated results;
an empty table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices

SEPARATORS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NAMES = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "longest_word", "n_upper", "n_digits", "n_marks", "n_bangs", "n_pipes", "n_wide", "n_stops")
RATIOS = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "distinct_rate": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper_rate": ("n_upper", "word_chars"),
    "digit_rate": ("n_digits", "word_chars"),
    "mark_rate": ("n_marks", "n_words"),
    "bang_rate": ("n_bangs", "n_words"),
    "pipe_rate": ("n_pipes", "n_words"),
    "wide_rate": ("n_wide", "word_chars"),
    "stop_rate": ("n_stops", "n_words"),
}
FEATURES = ("n_words", "n_lines", "longest_word", *RATIOS)
WINDOW = 5
SLICE = 2 << 20


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


SEPARATOR = _mask(SEPARATORS)
CLASSES = {
    "n_symbols": _mask(SYMBOLS),
    "n_upper": _mask(bytes(range(65, 91))),
    "n_digits": _mask(b"0123456789"),
    "n_marks": _mask(bytes(b for b in range(33, 127) if not chr(b).isalnum())),
    "n_bangs": _mask(b"!"),
    "n_pipes": _mask(b"|"),
    "n_stops": _mask(b".?"),
}
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
CODES = np.random.default_rng(20_240).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, ODD, dtype=np.uint64), np.full(n + 1, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64, up to ``n``."""
    return _powers(SLICE if n <= SLICE else 1 << n.bit_length())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, low ones too."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Buffer:
    """The bytes of a string column slice with its text bounds, its words and hashes of runs."""

    def __init__(self, column: pa.Array):
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.bounds = bounds - bounds[0]
        self.raw = raw[bounds[0] : bounds[-1]]
        self.rows = len(column)
        self._hashes = None

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[self.bounds])

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of flagged bytes; runs end with their text."""
        if not len(flags):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = np.zeros(len(flags) + 1, dtype=bool)
        inner = self.bounds[:-1][self.bounds[:-1] < len(flags)]
        first[inner] = True
        before = np.concatenate(([False], flags[:-1]))
        after = np.concatenate((flags[1:], [False]))
        starts = np.flatnonzero(flags & (~before | first[:-1]))
        ends = np.flatnonzero(flags & (~after | np.concatenate((first[1:-1], [True])))) + 1
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte runs; equal runs have equal hashes wherever they stand."""
        up, down = powers(len(self.raw))
        if self._hashes is None:
            self._hashes = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(CODES[self.raw] * up[: len(self.raw)], dtype=np.uint64)))
        return mixed((self._hashes[ends] - self._hashes[starts]) * down[starts])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    later = np.zeros(len(keys), dtype=bool)
    twice = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def count(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts NAMES of each text of a string column."""
    b = Buffer(column)
    raw = b.raw
    leading = (raw & 0xC0) != 0x80
    inside = ~SEPARATOR[raw]
    out = {"n_bytes": np.diff(b.bounds), "n_chars": b.per_text(leading), "word_chars": b.per_text(inside & leading), "n_wide": b.per_text(raw >= 0xC0)}
    out |= {name: b.per_text(mask[raw]) for name, mask in CLASSES.items()}
    starts, ends = b.runs(inside)
    owner = b.owner(starts)
    out["n_words"] = np.bincount(owner, minlength=b.rows)
    letters = np.concatenate(([0], np.cumsum(leading, dtype=np.int64)))
    longest = np.zeros(b.rows, dtype=np.int64)
    np.maximum.at(longest, owner, letters[ends] - letters[starts])
    out["longest_word"] = longest
    words = b.hashes(starts, ends)
    salt = mixed(np.arange(1, b.rows + 1, dtype=np.uint64))
    _, later = repeated(words ^ salt[owner])
    out["n_distinct_words"] = np.bincount(owner[~later], minlength=b.rows)
    out["n_repeat_words"] = np.zeros(b.rows, dtype=np.int64)
    if len(words) >= WINDOW:
        n = len(words) - WINDOW + 1
        key = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(ODD) + words[k : k + n]
        whole = owner[:n] == owner[WINDOW - 1 :]
        twice = np.zeros(n, dtype=bool)
        at = np.flatnonzero(whole)
        twice[at] = repeated(mixed(key[at]) ^ salt[owner[at]])[0]
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        hit = np.flatnonzero(twice)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        covered = np.cumsum(cover)[:-1] > 0
        out["n_repeat_words"] = np.bincount(owner[covered], minlength=b.rows)
    line_starts, line_ends = b.runs(raw != 10)
    filled = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    worded = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = b.owner(line_starts)
    out["n_lines"] = np.bincount(line_owner, minlength=b.rows)
    _, later = repeated(b.hashes(line_starts, line_ends) ^ salt[line_owner])
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=b.rows)
    return out


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text of FEATURES; a rate over nothing is 0."""
    table = {k: v.astype(np.float64) for k, v in counts.items()}
    for name, (above, below) in RATIOS.items():
        table[name] = table[above] / np.maximum(table[below], 1.0)
    return np.column_stack([table[f] for f in FEATURES])


def map_counts(df: DataFrame, work: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``work(slice, counts)`` over slices of (id, text, *extra)."""

    def run(batches):
        for part in slices(batches, limit=SLICE):
            yield work(part, count(part.column(1)))

    return df.select(df[id_col], df[text_col].cast("string"), *[df[c] for c in extra]).mapInArrow(run, schema)


def document_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, the counts NAMES (long), then ``extra`` columns of the input."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def work(part, counts):
        return pa.RecordBatch.from_arrays([part.column(0), *[pa.array(counts[n].astype(np.int64)) for n in NAMES], *[part.column(2 + i) for i in range(len(extra))]], names=[id_col, *NAMES, *extra])

    return map_counts(df, work, ", ".join([f"`{id_col}` {kinds[id_col]}", *[f"{n} long" for n in NAMES], *[f"`{c}` {kinds[c]}" for c in extra]]), id_col, text_col, extra)
