"""Alignment of two tokenizers: products of sparse token-by-byte matrices, held as hand-built CSR."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import bpe
from emberwatch.session import checkpointed

#: Texts are aligned together up to so many bytes; a longer text is aligned alone.
BATCH_BYTES = 1 << 18
#: Documents that look up the corpus counts together hold about so many links; a document is never cut.
CHUNK_LINKS = 1_000_000
#: Products of one block of rows.
BLOCK = 1 << 20
#: Words in the cache of each tokenizer, in one worker.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 48
BLANK = "▁"
#: bpe.PIECES for texts of ASCII alone.
ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Csr(NamedTuple):
    """A sparse 0/1 matrix: the columns of row i are cols[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    cols: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover consecutive runs of columns: a text's tokens over its bytes."""
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Rows with one column each: tokens over their groups."""
        return cls(np.arange(len(labels) + 1), labels, width)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        """The same entries by column: a stable counting sort."""
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        order = np.argsort(self.cols, kind="stable")
        return Csr(starts, self.rows[order], len(self.starts) - 1)


def row_products(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A times B row by row (Gustavson): blocks of (row, column, sum), rows ascending, columns ascending in a row.

    Row i gathers the rows of B that its columns name; equal columns are summed. A block holds about BLOCK products, or
    one row.
    """
    per_row = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.cols])])[a.starts]
    at, rows = 0, len(a.starts) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(per_row, per_row[at] + BLOCK, side="right")) - 1)
        through = a.cols[a.starts[at]:a.starts[end]]
        sizes = b.starts[through + 1] - b.starts[through]
        row = np.repeat(np.repeat(np.arange(at, end), np.diff(a.starts[at:end + 1])), sizes)
        shift = b.starts[through] - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        key = row * b.width + b.cols[np.repeat(shift, sizes) + np.arange(len(row))]
        if (key[1:] < key[:-1]).any():
            key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        sums = np.diff(np.concatenate([heads, [len(key)]]))
        yield key[heads] // b.width, key[heads] % b.width, sums
        at = end


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries in each row of A times B where the rows of B that meet in a row of A are disjoint (no sums to make)."""
    return np.add.reduceat(np.append(np.diff(b.starts)[a.cols], 0), a.starts[:-1]) * (np.diff(a.starts) > 0)


class Alignment(NamedTuple):
    """Tokens of two tokenizers over the same bytes: their groups, as incidence matrices."""

    a_spans: Csr
    b_spans: Csr
    a_groups: Csr
    b_groups: Csr

    @classmethod
    def of_lengths(cls, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
        """Groups end at the bytes where a token of both ends; both must cover equally many bytes."""
        a, b = Csr.of_spans(a_lengths), Csr.of_spans(b_lengths)
        ends = np.intersect1d(a.starts[1:], b.starts[1:], assume_unique=True)
        groups = [Csr.of_labels(np.searchsorted(ends, m.starts[1:]), len(ends)) for m in (a, b)]
        return cls(a, b, *groups)

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (token of A, token of B, bytes they share)."""
        return row_products(self.a_spans, self.b_spans.transposed())

    def shared_group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (token of A, token of B, 1) for tokens of one group."""
        return row_products(self.a_groups, self.b_groups.transposed())

    def shared_group_sizes(self) -> np.ndarray:
        """For each token of A how many of B are in its group: the row sizes of the same product, without the product."""
        return row_sizes(self.a_groups, self.b_groups.transposed())


class Words:
    """Ids of texts by their words, which a tokenizer encodes on their own; a bounded cache holds the short ones."""

    def __init__(self):
        self.cache: dict[str, bytes | None] = {}

    def encoded(self, words: list[str]) -> list[bytes | None]:
        """Ids of words as bytes of little-endian uint32; None for what is not encoded word by word."""
        raise NotImplementedError

    def join(self, split: list[list[str]]) -> list[bytes | None]:
        """Ids of each list of words. What is new to the cache is encoded together."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        fresh = [w for w in set().union(*split) if w not in cache]
        cache.update(zip(fresh, self.encoded(fresh)))
        out = []
        for words in split:
            try:
                out.append(b"".join(map(cache.__getitem__, words)))
            except TypeError:  # a word without ids
                out.append(None)
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out


def flattened(coded: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and where those of each list start; the last number is where the last list ends."""
    coded = list(coded)
    starts = np.cumsum([0, *map(len, coded)])
    return np.fromiter(chain.from_iterable(coded), "<u4", int(starts[-1])), starts


def cut(data: bytes, starts: np.ndarray) -> list[bytes]:
    return [data[i:j] for i, j in pairwise(starts.tolist())]


class ByteLevel(Words):
    """Tokenizer A: byte-level BPE, strings of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core: no threads of the library's own
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        self.token_bytes = bpe.MergeList.load(path).token_bytes
        self.lengths = np.array([len(t) for t in self.token_bytes])

    def encoded(self, words: list[str]) -> list[bytes]:
        ids, starts = flattened(e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False))
        return cut(ids.tobytes(), 4 * starts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.join([(ASCII_PIECES if t.isascii() else bpe.PIECES).findall(" " + t) for t in texts])


class Pieces(Words):
    """Tokenizer B: pieces with a blank sign for spaces, bytes where no piece fits."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.token_bytes = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode()
                            for i, n in enumerate(names)]
        self.lengths = np.array([len(t) for t in self.token_bytes])
        self.blank = np.array([self.model.piece_to_id(BLANK)], dtype="<u4").tobytes()
        #: No piece goes on after a blank, so what lies between blanks is encoded on its own.
        self.words = None if any(re.search(f"[^{BLANK}]{BLANK}", n) for n in names) else re.compile(" *[^ ]+| +")

    def _packed(self, ids: list[int], text: str) -> bytes | None:
        """Ids as bytes; None where their bytes are not the text's."""
        if b"".join([self.token_bytes[i] for i in ids]) != text.encode():
            return None
        return np.array(ids, dtype="<u4").tobytes()

    def encoded(self, words: list[str]) -> list[bytes | None]:
        ids, starts = flattened(self.model.encode([w[1:] for w in words], num_threads=1))
        spelled = np.concatenate([[0], np.cumsum(self.lengths[ids])])[starts]
        spelled = cut(b"".join([self.token_bytes[i] for i in ids.tolist()]), spelled)
        return [self.blank if w == " " else packed if text == w.encode() else None
                for w, packed, text in zip(words, cut(ids.tobytes(), 4 * starts), spelled)]

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text; None where their bytes are not those of a space and the text."""
        plain = [t for t in texts if BLANK not in t]
        split = [self.words.findall(" " + t) if self.words else [" " + t] for t in plain]
        coded = [ids if ids is not None else self._packed(self.model.encode(t, num_threads=1), " " + t)
                 for t, ids in zip(plain, self.join(split))]
        left = iter(coded)
        return [next(left) if BLANK not in t else None for t in texts]


@lru_cache(maxsize=2)
def coders(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, dict[str, np.ndarray]]:
    """One per Python worker; the third are the ids in decimal, by the sign that follows them."""
    a, b = ByteLevel(a_path), Pieces(b_path)
    ids = range(max(len(a.lengths), len(b.lengths)))
    return a, b, {sign: np.array([f"{i}{sign}" for i in ids], dtype=object) for sign in ",|;"}


class Aligned(NamedTuple):
    """What one document brings: counts, the digest of its groups, and its linked id pairs (a * width + b), sorted."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    n_shared: int = 0
    groups_sha256: str = ""
    pairs: np.ndarray = np.zeros(0, dtype=np.int64)
    times: np.ndarray = np.zeros(0, dtype=np.int64)


def _digest(decimal: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
    """Hash of a1,a2|b1;a3|b2,b3: the ids of A, then of B, group by group."""
    ids = np.empty(len(a) + len(b), dtype=object)
    a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group)
    b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
    last = lambda g: np.concatenate([g[1:] != g[:-1], [True]])
    ids[a_at] = np.where(last(a_group), decimal["|"][a], decimal[","][a])
    ids[b_at] = np.where(last(b_group), decimal[";"][b], decimal[","][b])
    return hashlib.sha256("".join(ids.tolist())[:-1].encode()).hexdigest()


def aligned_texts(texts: list[str | None], a_path: str, b_path: str) -> Iterator[Aligned]:
    """One Aligned per text. The texts of a batch are the blocks of one block-diagonal product."""
    a_coder, b_coder, decimal = coders(a_path, b_path)
    coded = []
    by_pieces = b_coder.encode([t or "" for t in texts])
    by_pieces = [ids if t else None for t, ids in zip(texts, by_pieces)]
    by_bytes = iter(a_coder.encode([t for t, ids in zip(texts, by_pieces) if ids is not None]))
    for b in by_pieces:
        a = next(by_bytes) if b is not None else b""
        a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b or b"", "<u4").astype(np.int64)
        same = a_coder.lengths[a].sum() == b_coder.lengths[b].sum()
        coded.append((a, b) if same else (a[:0], b[:0]))
    a, b = (np.concatenate([c[side] for c in coded]) for side in (0, 1))
    a_from, b_from = (np.cumsum([0, *(len(c[side]) for c in coded)]) for side in (0, 1))
    whole = Alignment.of_lengths(a_coder.lengths[a], b_coder.lengths[b])
    width = len(b_coder.lengths)
    n_links, pairs = np.zeros(len(texts), dtype=np.int64), []
    for row, col, _ in whole.overlap_links():
        doc = np.searchsorted(a_from, row, side="right") - 1
        n_links += np.bincount(doc, minlength=len(texts))
        pairs.append((doc << 40) | (a[row] * width + b[col]))
    pairs, times = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.int64), return_counts=True)
    pair_from = np.searchsorted(pairs, np.arange(len(texts) + 1) << 40)
    shared = np.concatenate([[0], np.cumsum(whole.shared_group_sizes())])
    a_group, b_group = whole.a_groups.cols, whole.b_groups.cols
    for d in range(len(texts)):
        i, j, k, l = a_from[d], a_from[d + 1], b_from[d], b_from[d + 1]  # noqa: E741
        if i == j:
            yield Aligned()
            continue
        yield Aligned(int(j - i), int(l - k), int(a_group[j - 1] - a_group[i] + 1), int(n_links[d]),
                      int(shared[j] - shared[i]), _digest(decimal, a[i:j], b[k:l], a_group[i:j], b_group[k:l]),
                      pairs[pair_from[d]:pair_from[d + 1]] & ((1 << 40) - 1), times[pair_from[d]:pair_from[d + 1]])


CHUNKED = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_shared", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.binary()),
    ("times", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64())])
CHUNKED_SQL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
               "groups_sha256 string, places binary, times binary, pair long, docs long")


def _chunk_rows(chunk: int, held: list[tuple[int | None, Aligned]]) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, each with the places of its pairs among the chunk's, then the chunk's distinct pairs."""
    distinct, place = np.unique(np.concatenate([d.pairs for _, d in held]), return_inverse=True)
    bounds = np.cumsum([0, *(len(d.pairs) for _, d in held)])
    place = place.astype("<u4")
    docs = [(chunk, i, *d[:6], place[bounds[n]:bounds[n + 1]].tobytes(), d.times.astype("<u4").tobytes())
            for n, (i, d) in enumerate(held)]
    empty = pa.nulls(len(docs), pa.int64())
    yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*docs), CHUNKED)), empty, empty], schema=CHUNKED)
    if len(distinct):
        n = len(distinct)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), *(pa.nulls(n, f.type) for f in list(CHUNKED)[1:-2]), pa.array(distinct),
             pa.array(np.bincount(place, minlength=n))], schema=CHUNKED)


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        held, links = [], 0

        def taken(ids, texts):
            return zip(ids, aligned_texts(texts, a_path, b_path))

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_BYTES:
                    held += taken(ids, texts)
                    ids, texts, size = [], [], 0
                    links = sum(len(d.pairs) for _, d in held)
                if links >= CHUNK_LINKS:
                    yield from _chunk_rows(next(numbers), held)
                    held, links = [], 0
            if texts:
                held += taken(ids, texts)
        if held:
            yield from _chunk_rows(next(numbers), held)

    return run


def _looked_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The corpus counts of a chunk's pairs, in the places its documents name."""
    order = np.argsort(answers["pair"].to_numpy())
    counts = answers["count"].to_numpy()[order]
    best = answers["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for places, times in zip(docs["places"], docs["times"]):
        at, n = np.frombuffer(places.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * counts[at]).sum()))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    return pa.table([*(docs[c] for c in columns), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                     docs["groups_sha256"], docs["n_shared"]],
                    names=[*columns, "n_best", "count_sum", "groups_sha256", "n_shared"])


def pair_counts(chunked: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): documents that hold a pair of ids linked; best where no pair of its A id has more."""
    counts = checkpointed(chunked.groupBy("pair").agg(F.sum("docs").alias("count")))
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # no more rows than A has ids
    return counts.join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared for every row.

    A is a byte-level BPE file and encodes a space and the text; B is a piece model that adds the space itself. A link
    is a pair of tokens that share a byte; n_shared counts the pairs of tokens in one group. One row per input row,
    repeated rows included, each of which counts as a document. A text that is null, empty, or whose tokens do not spell
    it (one with U+2581, say) has no tokens: zeros and ''. A null doc_id keeps its row. No rows in, no rows out. A text of
    any length is read whole by one worker, which holds its tokens; links are made in blocks. Columns besides doc_id and
    text are ignored. Both paths name files installed with the software on each executor.

    Each text is encoded once. Documents ask for the counts of their pairs in chunks of about a million links, and a chunk asks
    once for a pair, so a pair has no more rows than there are chunks, however common it is.
    """
    width = len(coders(a_path, b_path)[1].lengths)
    table = checkpointed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_align(a_path, b_path), CHUNKED_SQL))
    asked = table.filter("pair is not null").select("chunk", "pair", "docs")
    answers = asked.join(pair_counts(asked, width), "pair").select("chunk", "pair", "count", "best")
    documents = table.filter("pair is null").drop("pair", "docs").withColumnRenamed("chunk", "home")
    return documents.groupBy("home").cogroup(answers.groupBy("chunk")).applyInArrow(
        _looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string, n_shared long")
