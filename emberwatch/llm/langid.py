"""Language identification with language-bitmask n-gram filters: one bit-sliced Bloom filter for all languages."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

UNKNOWN = "und"
ORDER = 4
PROBES = 2
#: A filter has the least power of two of slots at which the language with most n-grams fills FILL of them, within these
#: bounds. Beyond the upper one (128 MB for each 64 languages) filters are fuller, and scores are corrected for it: every
#: n-gram goes in at any size.
FILL = 0.3
SLOTS = (1 << 16, 1 << 24)
#: A prediction below this score names no language that the text is in; the stage rejects it.
MIN_SCORE = 0.2
FEW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _folding() -> np.ndarray:
    """Code point to its lower-case form; anything but letters becomes a blank."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_TABLE: list[np.ndarray] = []


def ngram_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, text number) of the n-grams of all texts: windows of folded code points inside a text, blanks as one."""
    if not _TABLE:
        _TABLE.append(_folding())
    # A blank on either side of each text; runs of blanks inside a text count as one.
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 2 for t in texts])
    folded = _TABLE[0][raw]
    again = (folded[1:] == 32) & (folded[:-1] == 32) & (owner[1:] == owner[:-1])
    keep = np.concatenate([np.ones(min(1, len(raw)), bool), ~again])
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    n = len(folded) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    ids = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER):
        ids = (ids << np.uint64(16)) ^ folded[i:i + n]
    whole = owner[:n] == owner[ORDER - 1:]
    return ids[whole], owner[:n][whole]


def slots_of(ids: np.ndarray, slots: int, probes: int = PROBES) -> Iterator[np.ndarray]:
    mixed = (ids ^ (ids >> np.uint64(29))) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    for i in range(probes):
        yield ((mixed >> np.uint64(8)) + np.uint64(i) * step) % np.uint64(slots)


def slices(texts: list[str | None], chars: int = 1 << 18) -> Iterator[list[str | None]]:
    """Successive texts of at most `chars` code points together, or one longer text: arrays grow with these, not with a batch."""
    held, size = [], 0
    for text in texts:
        n = len(text or "") + 2
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


def ngram_counts(docs: DataFrame, flush: int = 500_000) -> DataFrame:
    """(lang, ngram, n): counts over all whole texts with a lang, reduced inside each task before the shuffle.

    A task holds at most `flush` counts and those of one slice: beyond, equal n-grams become one, and a language that keeps
    over a quarter of `flush` hands its counts on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def one_of_each(lang: str) -> tuple[np.ndarray, np.ndarray]:
            ids, at = np.unique(np.concatenate([p[0] for p in held[lang]]), return_inverse=True)
            return ids, np.bincount(at, weights=np.concatenate([p[1] for p in held[lang]])).astype(np.int64)

        def rows(lang: str, ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"lang": lang, "ngram": ids.view(np.int64), "n": n})

        for frame in frames:
            for lang, texts in frame.groupby("lang", sort=False)["text"]:
                for part in slices(texts.tolist()):
                    ids, n = np.unique(ngram_ids(part)[0], return_counts=True)
                    held.setdefault(lang, []).append((ids, n))
                    size += len(ids)
                    if size > flush:
                        for name in list(held):
                            ids, n = one_of_each(name)
                            held[name] = [(ids, n)]
                            if len(ids) > flush // 4:
                                del held[name]
                                yield rows(name, ids, n)
                        size = sum(len(p[0][0]) for p in held.values())
                        if size > flush // 2:
                            for name in list(held):
                                yield rows(name, *held.pop(name)[0])
                            size = 0
        for lang in list(held):
            yield rows(lang, *one_of_each(lang))

    taught = docs.filter("lang is not null and text is not null").select("lang", "text")
    return taught.mapInPandas(run, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """`planes[w][slot]` holds a bit for each of the languages 64w to 64w+63; `fill` is each language's share of bits."""

    languages: list[str]
    planes: np.ndarray
    fill: np.ndarray

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, hits per text and language): each n-gram is looked up once for all languages."""
        ids, owner = ngram_ids(texts)
        total = np.bincount(owner, minlength=len(texts))
        found = np.zeros((len(texts), len(self.languages)))
        for w, plane in enumerate(self.planes):
            mask = None
            for slot in slots_of(ids, len(plane)):
                bits = plane[slot]
                mask = bits if mask is None else mask & bits
            for b in range(min(64, len(self.languages) - 64 * w)):
                has = (mask >> np.uint64(b)) & np.uint64(1)
                found[:, 64 * w + b] = np.bincount(owner, weights=has, minlength=len(texts))
        return total, found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the share of n-grams the language has, less what its filter would answer by chance."""
        total, found = self.hits(texts)
        chance = self.fill ** PROBES
        share = np.clip((found / np.maximum(total, 1)[:, None] - chance) / (1 - chance), 0, 1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        score = share[np.arange(len(texts)), best]
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0)


def slots_for(most: int) -> int:
    """Slots of a filter for languages with at most so many n-grams."""
    slots = SLOTS[0]
    while slots < SLOTS[1] and most * PROBES > FILL * slots:
        slots *= 2
    return slots


def train_filter(docs: DataFrame) -> LanguageFilter:
    """Count all training n-grams in Spark, set bits for all of them there, and gather the planes.

    A row per slot and 64 languages reaches the driver, no more than the filter has. Languages are the non-null values of
    `lang`, in order of name; rows without text teach nothing.
    """
    counts = checkpointed(ngram_counts(docs).select("lang", "ngram"))
    sizes = counts.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    slots, words = slots_for(max([r["count"] for r in sizes], default=0)), -(-len(languages) // 64)
    planes, fill = np.zeros((max(1, words), slots), dtype=np.uint64), np.zeros(len(languages))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, number = frame["ngram"].to_numpy().view(np.uint64), frame["number"].to_numpy()
            for slot in slots_of(ids, slots):
                yield pd.DataFrame({"word": number // 64, "slot": slot.astype(np.int64),
                                    "bits": (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)})

    numbers = docs.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    numbered = counts.join(F.broadcast(numbers), "lang").select("ngram", "number")
    table = numbered.mapInPandas(run, "word int, slot long, bits long").groupBy("word", "slot").agg(
        F.bit_or("bits").alias("bits")).toPandas()
    planes[table["word"].to_numpy(np.int64), table["slot"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64).view(np.uint64)
    for i in range(len(languages)):
        fill[i] = np.count_nonzero(planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots
    return LanguageFilter(languages, planes, fill)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Adds lang_pred and score to every row; every other column is kept, also one named like a helper.

    `lang_pred` is `und` with score 0 for a null text or one without a letter, and a learned language otherwise; equal
    shares go to the first language by name. Columns named lang_pred or score already are replaced. Repeated rows are
    repeated; no rows in, no rows out. A text of any length is read whole. The filter has at most SLOTS[1] x 8 bytes for each
    64 languages and is broadcast once. Languages are few: labels with very many values are to be cleaned before.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], [np.zeros(0)]
            for part in slices(texts.tolist()):
                n, s = sent.value.predict(part)
                names += n
                scores.append(s)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    judgement = judged("text")
    return docs.withColumns({"lang_pred": judgement["lang_pred"], "score": judgement["score"]})


def keep_identified(docs: DataFrame, model: LanguageFilter, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs` (same columns, one named lang_pred or score too) whose text is in a learned language.

    Rejected are texts without a letter, and those that score less than `min_score` on FEW n-grams or more: fewer tell too
    little to reject a text. Nulls, repeats and long texts: see identify.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    judged = identify(plain, model).filter(F.col("lang_pred") != UNKNOWN)
    kept = judged.filter((F.col("score") >= min_score) | (F.length(F.regexp_replace("text", r"\P{L}+", " ")) < FEW))
    return kept.select(*names).toDF(*docs.columns)
