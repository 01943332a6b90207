"""Token counts by section: a document is encoded once, token spans meet section spans, each token goes to one section."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.bpe import encoder

COUNTS = "array<struct<section:int,start:long,end:long,n_tokens:long,n_crossing:long>>"


def lines(text: str) -> list[tuple[int, int]]:
    """Character spans of a text's lines, each with the line feed that ends it: they cover the text without gaps."""
    ends, at = [], text.find("\n") + 1
    while at:
        ends.append(at)
        at = text.find("\n", at) + 1
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends))


def token_bounds(text: str, blocks: Iterator[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last character of each token; one that ends inside a character reaches over all of it."""
    ids = np.frombuffer(b"".join(blocks), "<u4")
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if len(text) == (ends[-1] if len(ends) else 0):
        return starts, ends
    heads = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return np.searchsorted(heads, starts, "right") - 1, np.searchsorted(heads, ends, "left")


def allot(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens per section: an interval join of two sorted lists.

    The rule: a token belongs to the section that holds most of its characters, of equals the first. A token outside
    all sections belongs to the last section before it (the first, if there is none before). Sections are sorted and
    don't overlap.
    """
    lows = np.array([s for s, _ in sections], dtype=np.int64)
    highs = np.array([e for _, e in sections], dtype=np.int64)
    first = np.clip(np.searchsorted(highs, starts, "right"), 0, len(lows) - 1)  # the first that ends behind the start
    last = np.clip(np.searchsorted(lows, ends, "left") - 1, 0, len(lows) - 1)  # the last that starts before the end
    home = np.minimum(first, last)
    share = lambda at, t: np.minimum(highs[at], ends[t]) - np.maximum(lows[at], starts[t])
    every = np.arange(len(starts))
    best = share(home, every)
    crossing = (last > first) & (share(first, every) > 0)
    wide = np.flatnonzero(last > home)
    step = 1
    while len(wide):
        at = first[wide] + step
        wide, at = wide[at <= last[wide]], at[at <= last[wide]]
        more = share(at, wide)
        better = more > best[wide]
        home[wide[better]], best[wide[better]] = at[better], more[better]
        step += 1
    return np.bincount(home, minlength=len(lows)), np.bincount(home[crossing], minlength=len(lows))


def section_tokens(docs: DataFrame, path: str, sections: Callable[[str], list[tuple[int, int]]] = lines) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row per section of each row of `docs`, in character offsets.

    The counts of a document's sections add up to its tokens, whatever crosses a boundary (see allot). A null or empty
    text has one empty section without tokens. Null ids and repeated rows keep their sections each; other columns are
    ignored. A document is one row from the encoder on, so a hot source or group of copies moves nothing.
    """

    @F.pandas_udf(COUNTS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        lengths = np.array(e.merges.lengths, dtype=np.int64)
        for texts in batches:
            out = []
            for text in texts:
                text = text or ""
                spans = sections(text) or [(0, len(text))]
                n, crossing = allot(*token_bounds(text, e.encode(text), lengths), spans)
                out.append([{"section": i, "start": s, "end": t, "n_tokens": a, "n_crossing": b}
                            for i, ((s, t), a, b) in enumerate(zip(spans, n.tolist(), crossing.tolist()))])
            yield pd.Series(out)

    rows = docs.select("doc_id", counted("text").alias("s"))
    # An inner explode would have the planner test for empty lists first, by encoding everything once more.
    return rows.select("doc_id", F.explode_outer("s").alias("s")).select("doc_id", "s.*")
