"""Byte-level BPE as a streaming transducer with the merge list's own bounded lookahead, and an incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern, as published for the vocabulary files, and the classes its runs are of.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
#: No piece that ends so many characters before the end of what is known can be changed by what follows.
PIECE_HOLD = 3
CHUNK = 1 << 16
#: Longer pieces are not kept whole: they pass through the byte window.
LONG_PIECE = 4096
WINDOW = 4096
CACHE_ENTRIES = 1_000_000
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """Ids, merges by rank and the sufficient lookahead of a byte-level BPE vocabulary file."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        self.ids, self.specials = vocab, specials
        self.byte_ids = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.rank = {(vocab[left], vocab[right]): r for r, (left, right) in reversed(list(enumerate(merges)))}
        self.made_by = [vocab[left + right] for left, right in merges]
        size = max([*vocab.values(), *specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for text, i in specials.items():
            self.token_bytes[i] = text.encode()
        self.lengths = [len(t) for t in self.token_bytes]
        self.lookahead = self._sufficient_lookahead(merges)

    @classmethod
    def load(cls, path: str) -> MergeList:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        plain = lambda t: bytes(alphabet[c] for c in t)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        return cls(vocab, [(plain(a), plain(b)) for a, b in merges], specials)

    @staticmethod
    def _sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes at the end of a known prefix that can still change, whatever follows it.

        Take two texts with a common prefix and the leftmost place where their partial tokenizations differ. A merge
        (x, v) across that place moves it left by len(x). The next merge that moves it has a higher rank, and its right
        part starts with x: it is x, or was made from x by merges no earlier than the first. So the ranks along a chain
        rise, and the longest chain follows from one pass down the merge list.
        """
        made = {left + right: r for r, (left, right) in reversed(list(enumerate(merges)))}
        reach: dict[bytes, int] = {}  # bytes that later merges can add to a move by a merge whose left part this is
        opens: list[list[tuple[bytes, int]]] = [[] for _ in merges]
        most = 0
        for r in range(len(merges) - 1, -1, -1):
            for token, value in opens[r]:
                reach[token] = max(reach.get(token, 0), value)
            left, right = merges[r]
            moved = len(left) + reach.get(left, 0)
            most = max(most, moved)
            if r:
                opens[r - 1].append((right, moved))
            while right in made:
                by = made[right]
                right = merges[by][0]
                opens[min(by, r)].append((right, moved)) if by < r else reach.update(
                    {right: max(reach.get(right, 0), moved)})
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece of text: always the merge of lowest rank, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, after = self.rank, self.made_by
        ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i] = after[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.made_by[r], -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i != -2]


class ByteWindow:
    """Tokens of one long piece, emitted once `lookahead` known bytes lie behind them; holds a bounded window."""

    def __init__(self, merges: MergeList, window: int = WINDOW):
        self.merges, self.held, self.limit = merges, b"", merges.lookahead + window

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.limit):
            self.held += data[at:at + self.limit]
            if len(self.held) >= self.limit:
                stable, done = len(self.held) - self.merges.lookahead, 0
                for token in self.merges.merge(self.held):
                    if done + self.merges.lengths[token] > stable:
                        break
                    done += self.merges.lengths[token]
                    yield token
                self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merge(self.held)
        self.held = b""


def packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, dtype="<u4").tobytes()


class Encoder:
    """Text in chunks to ids as little-endian 32-bit blocks; state is the undecided end of the text, of bounded size.

    Pieces of text are encoded on their own, so an emitted piece is final. Ids of short pieces are kept in a cache of
    bounded size. A piece beyond LONG_PIECE characters continues as a run of one character class through a ByteWindow.
    """

    def __init__(self, merges: MergeList):
        self.merges, self.cache = merges, {}
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
        self.hold = PIECE_HOLD + max([0, *(len(s) - 1 for s in merges.specials)])
        self.reset()

    def reset(self) -> None:
        self.rest, self.run, self.window = "", None, None

    def encode(self, text: str) -> Iterator[bytes]:
        """All blocks of one whole text."""
        self.reset()
        for at in range(0, len(text), CHUNK):
            yield from self.feed(text[at:at + CHUNK])
        yield from self.finish()

    def feed(self, chunk: str) -> Iterator[bytes]:
        yield from self._split(self.rest + chunk, final=False)

    def finish(self) -> Iterator[bytes]:
        yield from self._split(self.rest, final=True)
        self.reset()

    def _split(self, text: str, final: bool) -> Iterator[bytes]:
        """Special tokens cut the text: what lies before one ends there."""
        at = 0
        for hit in self.special.finditer(text) if self.special else ():
            yield from self._pieces(text[at:hit.start()], final=True)
            yield packed([self.merges.specials[hit[0]]])
            at = hit.end()
        yield from self._pieces(text[at:] if at else text, final)

    def _pieces(self, text: str, final: bool) -> Iterator[bytes]:
        if self.run is not None:
            text = yield from self._continue(text, final)
            if self.run is not None:
                return
        pieces = PIECES.findall(text)
        if final:
            self.rest = ""
        else:
            safe, end = len(text) - self.hold, len(text)
            while pieces and end > safe:
                end -= len(pieces.pop())
            self.rest = text[end:]
        yield self._known(pieces)
        if len(self.rest) > LONG_PIECE + self.hold:
            first = PIECES.match(self.rest)[0]
            if len(first) > LONG_PIECE:
                yield from self._enter(first)

    def _known(self, pieces: list[str]) -> bytes:
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            out = []
            for p in pieces:
                ids = cache.get(p)
                if ids is None:
                    if len(p) > LONG_PIECE:
                        window = ByteWindow(self.merges)
                        ids = packed([*window.feed(p.encode()), *window.finish()])
                    else:
                        ids = packed(self.merges.merge(p.encode()))
                    if len(p) <= 64:
                        if len(cache) >= CACHE_ENTRIES:
                            cache.clear()
                        cache[p] = ids
                out.append(ids)
            return b"".join(out)

    def _enter(self, piece: str) -> Iterator[bytes]:
        """The text at hand starts with a long piece that has not ended: go on with its class alone."""
        self.run = next(r for r in RUNS if r.match(piece[-1]))
        self.window, text, self.rest = ByteWindow(self.merges), self.rest, ""
        if piece[0] == " " and self.run is not RUNS[-1]:
            yield packed(self.window.feed(b" "))
            text = text[1:]
        self.rest = yield from self._continue(text, final=False)

    def _continue(self, text: str, final: bool) -> Iterator[bytes]:
        """Passes on what belongs to the run; returns what does not, or is undecided."""
        end = hit.end() if (hit := self.run.match(text)) else 0
        settled = len(text) if final else len(text) - self.hold  # a special token may start behind it
        ended = final or end < settled
        # The last blank before other text starts the next piece.
        keep = self.run is RUNS[-1] and not (final and end == len(text))
        take = max(0, min(end, settled) - keep)
        yield packed(self.window.feed(text[:take].encode()))
        self.rest = text[take:]
        if ended:
            yield packed(self.window.finish())
            self.run = self.window = None
        return self.rest


class Decoder:
    """Ids to text: bytes go through a UTF-8 state machine that holds at most one unfinished character."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, block: bytes) -> str:
        return self.state.decode(b"".join([self.merges.token_bytes[i] for i in np.frombuffer(block, "<u4").tolist()]))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(MergeList.load(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text; a null text has none. Repeated rows are repeated."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([np.frombuffer(b"".join(e.encode(t or "")), "<u4").astype(np.int32) for t in texts])

    return docs.select("doc_id", ids("text").alias("ids"))


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: encoded and decoded as a stream, digested block by block.

    One row per input row, repeated rows included; a null text counts as empty (no tokens, digests of nothing) and a
    null doc_id stays null. Other columns are ignored. `path` is read by each executor: a vocabulary file that is
    installed with the software.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids, decoded, n, d = hashlib.sha256(), hashlib.sha256(), 0, Decoder(e.merges)
                for block in e.encode(text or ""):
                    ids.update(block)
                    n += len(block) // 4
                    decoded.update(d.feed(block).encode())
                decoded.update(d.finish().encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
