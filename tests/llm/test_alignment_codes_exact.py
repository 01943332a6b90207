import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberwatch.llm import alignment, bpe, codes, exact

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcTh' \n\t.-=!#19é漢\u0085 \x00\x1c½Ⅷ​ñ😀́ﬁÅ", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "the", "ing",
         "  ", "====", "　", "word ", " house"]


# -- products ----------------------------------------------------------------------

def dense(m):
    out = np.zeros((len(m.starts) - 1, m.width), dtype=int)
    for i in range(len(out)):
        np.add.at(out[i], m.cols[m.starts[i]:m.starts[i + 1]], 1)
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_row_products_equal_dense_products(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(20):
        n, m, k = rng.integers(1, 9, 3)
        sizes = [rng.integers(0, 4, r) for r in (n, k)]
        a, b = (alignment.Csr(np.concatenate([[0], np.cumsum(s)]), rng.integers(0, w, s.sum()), int(w))
                for s, w in zip(sizes, (k, m)))
        assert (dense(b.transposed()) == dense(b).T).all()
        got = np.zeros((n, m), dtype=int)
        for row, col, value in alignment.row_products(a, b):
            assert (got[row, col] == 0).all()
            got[row, col] = value
        assert (got == dense(a) @ dense(b)).all()


def test_overlaps_and_groups_of_token_lengths():
    rng = random.Random(2)
    for _ in range(50):
        cut = lambda: np.diff([0, *sorted(rng.sample(range(1, 40), rng.randint(0, 20))), 40])
        a, b = cut(), cut()
        whole = alignment.Alignment.of_lengths(a, b)
        spans = [list(zip(np.cumsum(x) - x, np.cumsum(x))) for x in (a, b)]
        want = {(i, j): min(e, f) - max(s, t) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1])
                if min(e, f) > max(s, t)}
        assert {(i, j): n for part in whole.overlap_links() for i, j, n in zip(*part)} == want
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        group = [[sum(x < e for x in ends) for _, e in side] for side in spans]
        shared = {(i, j) for i in range(len(a)) for j in range(len(b)) if group[0][i] == group[1][j]}
        assert {(i, j) for part in whole.shared_group_links() for i, j, _ in zip(*part)} == shared
        assert whole.shared_group_sizes().sum() == len(shared)


# -- alignment of documents against the plain definition ---------------------------

def plain_alignment(texts):
    a_lib = Tokenizer.from_file(A_PATH)
    a_lib.encode_special_tokens = True
    a_lib.no_truncation()
    a_lib.no_padding()
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = bpe.byte_alphabet()
    rows, counts = [], {}
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a = a_lib.encode(" " + text, add_special_tokens=False).ids
        b = b_lib.encode(text)
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i)
                   else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append(None)
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        links, j = [], 0
        for i, end in enumerate(a_end):
            begin = end - len(a_bytes[i])
            while b_end[j] <= begin:
                j += 1
            k = j
            while k < len(b) and b_end[k] - len(b_bytes[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        common = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups, at = [], [0, 0]
        for end in common:
            group = []
            for side, (ids, ends) in enumerate(((a, a_end), (b, b_end))):
                first = at[side]
                while at[side] < len(ids) and ends[at[side]] <= end:
                    at[side] += 1
                group.append([str(i) for i in ids[first:at[side]]])
            groups.append(group)
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        digest = hashlib.sha256(";".join("|".join(map(",".join, g)) for g in groups).encode()).hexdigest()
        rows.append((len(a), len(b), len(groups), links, digest, sum(len(x) * len(y) for x, y in groups)))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "", 0) if r is None else
            (*r[:3], len(r[3]), sum(counts[p] == top[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), *r[4:]) for r in rows]


def test_alignment_of_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(300, "a▁b"), (301, " "), (302, "tail "), (303, "=" * 5000), (304, "<|endoftext|>"), (305, "x" * 70 + " y")]
    want = plain_alignment([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "'x' as chunk", "'x' as pair", "'x' as count", "'x' as best")
    order = lambda row: tuple((x is not None, x) for x in row)
    got = [tuple(r) for r in alignment.aligned(docs, A_PATH, B_PATH).collect()]
    assert sorted(got, key=order) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=order)
    assert sum(w[0] > 0 for w in want) > 60
    assert alignment.aligned(no_docs, A_PATH, B_PATH).count() == 0


def test_chunks_of_any_size_give_the_same(spark, tmp_path):
    """Chunk and batch sizes are read in the workers: an encoded run per size, straight through the generator."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(40)]
    whole = list(alignment.aligned_texts(texts, A_PATH, B_PATH))
    single = [x for t in texts for x in alignment.aligned_texts([t], A_PATH, B_PATH)]
    for one, other in zip(whole, single):
        assert one[:6] == other[:6] and (one.pairs == other.pairs).all() and (one.times == other.times).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_word_by_word_pieces_equal_the_library(text):
    a, b, _ = alignment.coders(A_PATH, B_PATH)
    want = b.model.encode(text)
    spelt = b"".join(b.token_bytes[i] for i in want) == (" " + text).encode()
    got = b.encode([text])[0]
    if text:
        assert (got is not None) == spelt
        if spelt:
            assert np.frombuffer(got, "<u4").tolist() == want
            whole = a.model.encode(" " + text, add_special_tokens=False).ids
            assert np.frombuffer(a.encode([text])[0], "<u4").tolist() == whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40) | st.lists(st.sampled_from([*" \n\t'", "'s", "'ll", "a", "7", "\x1c", "-"])).map("".join))
def test_ascii_texts_are_split_like_others(text):
    assert alignment.ASCII_PIECES.findall(" " + text) == bpe.PIECES.findall(" " + text)


def test_words_are_packed_together(monkeypatch):
    """Words new to the cache become bytes in one go; those that do not spell themselves are still told apart."""
    a, b, _ = alignment.coders(A_PATH, B_PATH)
    words = [" ", " the", " x\x00", "  two", " a▁b", " word", " ﬁ"]
    want = [b._packed(b.model.encode(w[1:]), w) if w != " " else b.blank for w in words]
    assert None in want and want.count(None) < len(want)
    monkeypatch.setattr(alignment.Pieces, "_packed", None)
    assert b.encoded(words) == want and b.encoded([]) == a.encoded([]) == []
    assert a.encoded(words) == [np.array(a.model.encode(w).ids, "<u4").tobytes() for w in words]


# -- codes ---------------------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 3, 4])
def test_nearest_equals_full_search(width):
    rng = np.random.default_rng(width)
    for k in (1, 2, 64):
        for spread in (2, 300):
            entries, points = rng.integers(-spread, spread, (k, width)), rng.integers(-spread, spread, (500, width))
            away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
            index, best = codes.nearest(points, entries)
            assert (index == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    far = codes.SUM_LIMIT // width
    index, best = codes.nearest(np.full((1, width), far), np.full((2, width), -far))
    assert index[0] == 0 and best[0] == width * (2 * far) ** 2


def plain_codes(rows, parts=16, entries=64, rounds=2):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows]
    width = len(whole[0][1]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        away = lambda x, p: [(sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])]
        picked = [[min(away(c[p], p)) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, k in zip(cut, picked) if k[p][1] == e]
                    if mine:
                        books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = {}
    for (_, _, label), k in zip(whole, picked):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in k)
    return [(i, bytes(j for _, j in k).hex(), sum(d for d, _ in k), errors[label], digest)
            for (i, _, label), k in zip(whole, picked)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n,entries", [(150, 64), (5, 64), (60, 7)])
def test_codes_match_brute_force(spark, n, entries):
    rng = np.random.default_rng(n)
    rows = [(i * 3 - 20, [float(x) for x in rng.standard_normal(32).astype(np.float32)], int(i % 3) if i % 7 else None)
            for i in range(n)]
    rows.append((rows[-1][0] + 1, rows[0][1], 1))
    odd = [(-99, None, 1), (-98, [float("nan")] * 32, 1), (-97, [float("inf")] + [0.0] * 31, 1), (-96, [None] + [0.0] * 31, 1)]
    df = spark.createDataFrame([*rows, *odd], VECTORS).repartition(3).selectExpr("*", "1 as whole", "2 as code", "3 as of")
    got = sorted(tuple(r)[:5] for r in codes.compressed(df, entries=entries).collect())
    assert got == sorted(plain_codes(rows, entries=entries))


def test_codes_of_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert codes.compressed(make([])).count() == 0
    assert codes.compressed(make([(1, None, 1)])).count() == 0
    (empty,) = codes.compressed(make([(1, [], 1)])).collect()
    assert (empty["code"], empty["error"], empty["label_error"]) == ("00" * 16, 0, 0)
    mixed = [(1, [0.5] * 20, 1), (2, [0.25] * 20, None), (None, [0.5] * 20, None), (3, [1.0], 1), (1, [0.5] * 20, 1),
             (4, [3e38] * 20, 2)]
    got = {(r["vec_id"], r["code"] is None) for r in codes.compressed(make(mixed)).collect()}
    assert got == {(1, False), (2, False), (None, False), (3, True), (4, False)}
    assert codes.compressed(make(mixed)).count() == 6


# -- exact dedup ---------------------------------------------------------------------

def plain_groups(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), text in zip(rows, norm):
        ids = [j for (j, _), t in zip(rows, norm) if t == text]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check_groups(got, rows):
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=order) == sorted(
        plain_groups(rows), key=order)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("bucket_bytes,depth", [(64 << 20, 16), (400, 3), (1, 4)])
def test_exact_groups_match_brute_force(spark, odd_docs, bucket_bytes, depth):
    rng = random.Random(depth)
    texts = ["", " ", "a b", "a\t\n b", "a  b", "A b", "a b", "a\x1cb", "x" * 3000, *("t%d" % i for i in range(40))]
    rows = [(rng.randrange(500), rng.choice(texts)) for _ in range(200)] + [(i, "hot one") for i in range(150)]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(None, "nobody"), (None, "nobody"), (None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr(
        "*", "'x' as h", "'x' as row", "'x' as copies", "'x' as norm", "'x' as bucket")
    check_groups(exact.deduplicated(docs, bucket_bytes, depth).collect(), rows)


def test_exact_groups_of_nothing(spark, no_docs):
    assert exact.deduplicated(no_docs).count() == 0


def test_texts_with_one_hash_are_chained_and_told_apart(spark, monkeypatch):
    rows = [(i, f"text {i % 6}") for i in range(40)]
    real = exact.F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(7).cast("long") if c == ("norm",) else real(*c))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket_bytes in (64 << 20, 100):
        check_groups(exact.deduplicated(docs, bucket_bytes, 4).collect(), rows)


def test_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(3)
    loads = rng.integers(0, 10, 256)
    loads[77] = 1000
    directory = exact.Directory(loads, 40)
    assert len(directory.pointers) == 1 << directory.depth == 256
    for cell in range(256):
        local, prefix = directory.buckets[directory.pointers[cell]]
        assert cell >> (8 - local) == prefix
    for b, (local, prefix) in enumerate(directory.buckets):
        span = 1 << (8 - local)
        assert loads[prefix * span:(prefix + 1) * span].sum() <= 40 or local == 8
        assert directory.pointers.count(b) == 1 << (directory.depth - local)
    assert exact.Directory(np.zeros(16, dtype=int), 1).depth == 0
