import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberwatch.llm import bpe, spans

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abcTh' \n\t.-=!#19é漢\u0085 \x1c½Ⅷ​ñ😀́", "<|endoftext|>", "<|end", "the", "ing", "  ", "====", "'ll",
         "\r\n", "    ", "'re", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(e, text):
    return np.frombuffer(b"".join(e.encode(text)), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.sampled_from([(5, 7), (17, 40), (1 << 16, 4096)]))
def test_encoder_equals_the_library(text, sizes):
    library, e = Tokenizer.from_file(PATH), bpe.encoder(PATH)
    old = bpe.CHUNK, bpe.LONG_PIECE
    bpe.CHUNK, bpe.LONG_PIECE = sizes
    try:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(e, text) == want
        d = bpe.Decoder(e.merges)
        assert "".join(d.feed(b) for b in e.encode(text)) + d.finish() == text
    finally:
        bpe.CHUNK, bpe.LONG_PIECE = old


def test_long_pieces_stream_in_a_bounded_window(library):
    e, rng = bpe.encoder(PATH), random.Random(1)
    for parts in (["ab", "the", "ing", "qu", "tion", "zz", "A"], list("abcdefgh"), ["="], [" "], ["é", "ü"]):
        text = "".join(rng.choice(parts) for _ in range(20_000)) + "1 x"
        assert ids(e, text) == library.encode(text, add_special_tokens=False).ids
    window = bpe.ByteWindow(e.merges)
    for _ in range(40):
        list(window.feed(b"theingqu" * 1000))
        assert len(window.held) <= e.merges.lookahead + bpe.WINDOW


def test_lookahead_suffices_for_random_merge_lists():
    """Whatever follows a prefix, the tokens that end `lookahead` bytes before its end stay."""
    rng = random.Random(9)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 14:
            left, right = rng.choice(tokens), rng.choice(tokens)
            if left + right not in tokens and len(left + right) < 9:
                merges.append((left, right))
                tokens.append(left + right)
        m = bpe.MergeList({t: i for i, t in enumerate(tokens)}, merges, {})
        for _ in range(60):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
            cut = rng.randint(0, len(text))
            whole, at, ends = m.merge(text), 0, set()
            for t in whole:
                at += m.lengths[t]
                ends.add(at)
            at = 0
            for t in m.merge(text[:cut]):
                at += m.lengths[t]
                if at <= cut - m.lookahead:
                    assert at in ends
            window = bpe.ByteWindow(m, window=3)
            assert [*window.feed(text[:cut]), *window.feed(text[cut:]), *window.finish()] == whole


def test_decoder_replaces_as_the_library_does(library):
    rng, e = random.Random(4), bpe.encoder(PATH)
    for _ in range(50):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 40))]
        d = bpe.Decoder(e.merges)
        got = "".join(d.feed(bpe.packed([i])) for i in some) + d.finish()
        assert got == library.decode(some, skip_special_tokens=False)


def test_round_trips_of_odd_documents(odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        text = r["text"] or ""
        raw = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        want.append((str(r["doc_id"]), len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.round_trips(odd_docs, PATH).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.round_trips(no_docs, PATH).count() == 0
    assert sorted(len(r["ids"]) for r in bpe.encoded(odd_docs, PATH).collect()) == sorted(w[1] for w in want)


def plain_allot(offsets, sections):
    n, crossing = [0] * len(sections), [0] * len(sections)
    for s, e in offsets:
        share = [min(e, b) - max(s, a) for a, b in sections]
        if max(share) > 0:
            home = max(range(len(sections)), key=lambda k: (share[k], -k))
            crossing[home] += sum(x > 0 for x in share) > 1
        else:
            home = max([k for k, (a, _) in enumerate(sections) if a <= s], default=0)
        n[home] += 1
    return n, crossing


def test_tokens_are_allotted_by_the_rule():
    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.sample(range(40), 8))
        gaps = rng.random() < 0.5
        sections = [(a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if not gaps or i % 2 == 0]
        ends = sorted(rng.sample(range(1, 45), 12))
        offsets = list(zip([0, *ends], ends))
        got = spans.allot(np.array([s for s, _ in offsets]), np.array([e for _, e in offsets]), sections)
        assert [list(map(int, x)) for x in got] == [list(x) for x in plain_allot(offsets, sections)]


def test_section_counts_of_odd_documents(odd_docs, no_docs, library):
    rows = {str(r["doc_id"]) + str(r["text"]): r["text"] or "" for r in odd_docs.select("doc_id", "text").collect()}
    got = spans.section_tokens(odd_docs, PATH).toPandas()
    assert got["n_tokens"].sum() == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids)
                                        for r in odd_docs.select("text").collect())
    assert len(got[got.doc_id == 2]) == 2 and len(rows) == 13
    assert spans.section_tokens(no_docs, PATH).count() == 0
    text = "héllo\n\nwörld 漢字\n"
    assert spans.lines(text) == [(0, 6), (6, 7), (7, 16)]
    halves = spans.section_tokens(odd_docs.filter("doc_id = 9"), PATH, lambda t: [(0, 7), (7, len(t))]).collect()
    assert sum(r["n_tokens"] for r in halves) == len(library.encode("été à la plage", add_special_tokens=False).ids)
