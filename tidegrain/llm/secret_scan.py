"""Secret scans: three fixed patterns, and the Shannon entropy of a window sliding over candidate strings of each character class.

A window's entropy is kept by counts: as the window moves, one character enters and one leaves, and only their terms change.
Windows above the threshold of their class are joined into spans. An allow-list drops what is known to be harmless.

Texts are first tested by cheap necessary signs (a keyword, the access prefix, a long run of a class); only the others' full scan is
skipped, so the result is that of scanning every text. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; very long texts are scanned whole; repeated rows give repeated results; an empty
table gives an empty table; other columns are not read (``redact`` keeps them as they are).
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices, table, texts_of
from .stats import Buffer

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
#: Character classes: the candidate strings of each, and the bits a character from which a window is hot.
CLASSES = {"entropy_hex": (re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}"), 3.0), "entropy_base64": (re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"), 3.9)}
ALLOWED = (
    re.compile(r"[A-Za-z+/_=-]*"),  # no digit: words, paths and rulers
    re.compile(r"[0-9+/_=-]*"),  # no letter: numbers and dates
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # identifiers
)
HARMLESS = re.compile(r"(?i)example|sample|placeholder|changeme|your[_-]?key|dummy|x{6,}|0{8,}")
FIELD = re.compile(r"[^/=]+")
TERMS = [0.0, *[c * math.log2(c) for c in range(1, WINDOW + 1)]]

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return found


def hot_windows(candidate: str, bits: float) -> list[tuple[int, int]]:
    """Joined windows of WINDOW characters whose entropy is at least ``bits``; linear in the candidate."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window
    most = WINDOW * (math.log2(WINDOW) - bits) + 1e-9
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(candidate):
        c = counts.get(ch, 0)
        total += TERMS[c + 1] - TERMS[c]
        counts[ch] = c + 1
        if i >= WINDOW:
            gone = candidate[i - WINDOW]
            c = counts[gone]
            total += TERMS[c - 1] - TERMS[c]
            counts[gone] = c - 1
        if i >= WINDOW - 1 and total <= most:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans of hot windows that are not allowed, without what spans found before cover; what is left of one has WINDOW characters at least."""
    taken = sorted((s, e) for _, s, e in taken)
    found: list[Span] = []
    for kind, (pattern, bits) in CLASSES.items():
        for m in pattern.finditer(text):
            if any(a.fullmatch(m[0]) for a in ALLOWED):
                continue
            for start, end in hot_windows(m[0], bits):
                for s, e in outside(m.start() + start, m.start() + end, sorted([*taken, *harmless(m)])):
                    if e - s >= WINDOW and not any(a.fullmatch(text[s:e]) for a in ALLOWED):
                        found.append((kind, s, e))
        taken = sorted([*taken, *[(s, e) for _, s, e in found]])
    return found


def outside(start: int, end: int, taken: list[Span]) -> list[tuple[int, int]]:
    """What of start..end lies in none of the sorted spans."""
    out = []
    for s, e in taken:
        if e > start and s < end:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if s < e]


def harmless(candidate: re.Match) -> list[tuple[int, int]]:
    """The fields of a candidate, cut at / and =, that hold a harmless word."""
    return [(candidate.start() + m.start(), candidate.start() + m.end()) for m in FIELD.finditer(candidate[0]) if HARMLESS.search(m[0])]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, each in order."""
    base = base_spans(text)
    return in_order(base), in_order(base + entropy_spans(text, base))


def suspects(column: pa.Array, texts: list[str]) -> np.ndarray:
    """Which texts can have a span at all."""
    b = Buffer(column)
    flags = np.zeros(256, dtype=bool)
    flags[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
    starts, ends = b.runs(flags[b.raw])
    out = np.zeros(b.rows, dtype=bool)
    out[b.owner(starts[ends - starts >= WINDOW])] = True  # also every hex span of 32 and more
    for i, t in enumerate(texts):
        if not out[i]:
            out[i] = "AKIA" in t or any(k in low for low in (t.lower(),) for k in KEYWORDS)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            texts = texts_of(part.column(1))
            found = [scan(t) if s else ([], []) for t, s in zip(texts, suspects(part.column(1), texts), strict=True)]
            counts = [pa.array([sum(k == name for k, _, _ in base) for base, _ in found], pa.int64()) for name in KINDS[:3]]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([joined(every) for _, every in found], pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def blank(text: str, spans: list[Span], mark: str) -> str:
    """The text with each (joined) span replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: (x[1], x[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in the text, and the length column counted again where the text changed."""
    names = docs.columns
    at = names.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for part in slices(batches, column=at):
            texts = part.column(at).to_pylist()
            seen = suspects(part.column(at), ["" if t is None else t for t in texts])
            columns = list(part.columns)
            changed = {}
            for i in np.flatnonzero(seen):
                spans = scan(texts[i])[1]
                if spans:
                    changed[i] = blank(texts[i], spans, mark)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if length_col in names:
                    k = names.index(length_col)
                    columns[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, kinds)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
