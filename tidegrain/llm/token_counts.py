"""Token counts of sections by offset mapping: encode a whole text once, then join token spans to section spans.

A token that crosses a section boundary goes to the section that holds most of its characters; on a tie, to the earlier one.
Each token is counted once, so the counts of a text's sections add up to its number of tokens.

Defined results: sections are the lines of a text, each with the newline that ends it; a null or empty text is one empty section
without tokens; repeated rows give repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import map_texts, table
from .bpe import codec, vocabulary


def line_starts(text: str) -> np.ndarray:
    """Character positions where lines begin; a newline that ends the text begins no line."""
    units = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    breaks = np.flatnonzero(units == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(units)])).astype(np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token span, and whether it crosses a boundary. ``sections``: sorted start positions, the first 0."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    home = first.copy()
    crossing = np.flatnonzero(last > first)
    stops = np.append(sections[1:], length)
    for t in crossing:
        own = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[own], ends[t]) - np.maximum(sections[own], starts[t])
        home[t] = own[int(np.argmax(held))]
    crosses = np.zeros(len(starts), dtype=bool)
    crosses[crossing] = True
    return home, crosses


def section_tokens(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", sections=line_starts) -> DataFrame:
    """One row per section: id, section (from 0), start, end (code points), n_tokens, n_crossing (tokens here that cross a boundary)."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    kind = df.schema[id_col].dataType.simpleString()

    def work(part, texts):
        tool = codec(path, pattern)
        ids, counts = tool.encode(texts)
        rows, number, begin, stop, tokens, crossing = [], [], [], [], [], []
        for row, (text, own) in enumerate(zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True)):
            at = sections(text)
            n = len(at)
            if len(own):
                starts, ends = tool.spans(text, own)
                home, crosses = allocate(starts, ends, at, len(text))
                tokens.append(np.bincount(home, minlength=n))
                crossing.append(np.bincount(home[crosses], minlength=n))
            else:
                tokens.append(np.zeros(n, dtype=np.int64))
                crossing.append(np.zeros(n, dtype=np.int64))
            rows.append(np.full(n, row))
            number.append(np.arange(n))
            begin.append(at)
            stop.append(np.append(at[1:], len(text)))
        longs = [pa.array(np.concatenate(x).astype(np.int64)) for x in (number, begin, stop, tokens, crossing)]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), *longs], names=[id_col, "section", "start", "end", "n_tokens", "n_crossing"])

    return map_texts(df, id_col, text_col, work, f"`{id_col}` {kind}, section long, start long, end long, n_tokens long, n_crossing long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
