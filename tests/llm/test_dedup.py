import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from made_texts import prose

from emberwatch.llm import simhash, vectors
from emberwatch.llm.base import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_is_the_contract():
    for text in (None, "", " ", "a", "A b", "a b c", "x " * 5, prose(3, 500), "É é\x1fz\x0bq"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_position_sets_cover_every_agreement():
    from itertools import combinations

    for width in (3, 4, 5):
        for agreed in combinations(range(8), 5):
            assert any(set(s) <= set(agreed) for s in simhash.position_sets(width))


@pytest.mark.parametrize("width, list_rows", [(3, 4096), (4, 4096), (5, 4096), (3, 5), (5, 5)])
def test_links_match_brute_force(spark, monkeypatch, width, list_rows):
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    rng = random.Random(width)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [fps[0] ^ rng.getrandbits(24) << 20 for _ in range(60)]  # they share bytes, few of them are in reach
    for _ in range(160):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    found = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), width)
    edges = [(signed.index(r["a"]), signed.index(r["b"])) for r in found.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in edges)
    assert roots(len(fps), edges) == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(3, 3), (7, 500), (500, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in (7, 10, 59, 500, 501)} == {7}
    assert 3 not in got


def test_groups_of_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(odd_docs).collect()]
    fps = [plain_fingerprint(r["text"]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, c in zip(rows, root):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, root)]
    key = lambda t: (str(t[0]), t[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    # One row per group; the nameless text is alone in its own, the null and blank ones belong to document 3's.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [*least.values(), None]))
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_one_id_with_unrelated_texts_keeps_each(spark):
    one, two, three = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, one), (1, two), (2, three), (5, one), (1, two), (3, two + " x"), (4, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each_group(docs).collect())
    assert got == sorted([(1, one), (1, two), (2, three)])


VECTORS = "vec_id long, embedding array<float>, label int, unit string, id string, cell string"


def brute(rows, threshold=0.98):
    units = []
    for _, v, label in rows:
        v = None if v is None or label is None or any(x is None for x in v) or not v else np.array(v, float)
        ok = v is not None and np.isfinite(v).all() and np.abs(v).max() > 0
        units.append(v / np.linalg.norm(v) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None
             and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    return pairs


@pytest.mark.parametrize("cell_rows", [4000, 20])
def test_near_vectors_match_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        centre = rng.standard_normal(6)
        for _ in range(rng.integers(1, 8)):
            rows.append([float(x) for x in centre + rng.standard_normal(6) * rng.choice([0.02, 0.08, 0.3])])
    rows = [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(12)]
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [float("nan")] * 6, 1), (903, [1.0, None, 0, 0, 0, 0], 1),
             (904, [float("inf"), 0, 0, 0, 0, 0], 1), (905, rows[0][1], None), (906, [], 0), (907, [1.0, 2.0], 0),
             (908, [2.0, 4.0], 0), (909, [x * 2 for x in rows[0][1]], rows[0][2])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    pairs = brute(rows)
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    root = roots(len(rows), pairs)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    want = {r[0]: (int(links[i]), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_a_dense_cell_is_reduced_as_it_is_read():
    rng = np.random.default_rng(3)
    units = np.abs(rng.standard_normal((1500, 8))) * 0.05 + np.eye(8)[rng.integers(0, 3, 1500)]
    units /= np.linalg.norm(units, axis=1)[:, None]
    frame = pd.DataFrame({"id": rng.permutation(1500), "copies": rng.integers(1, 4, 1500), "away": rng.integers(0, 3, 1500),
                          "unit": list(units), "side": 1})
    away, copies = frame["away"].to_numpy(), frame["copies"].to_numpy()
    hit = (units @ units.T >= 0.98) & ((away[:, None] & away) == 0)
    np.fill_diagonal(hit, False)
    group = roots(1500, list(zip(*np.nonzero(np.tril(hit)))))
    ids = frame["id"].to_numpy()
    least = {}
    for i, g in enumerate(group):
        least[g] = min(ids[i], least.get(g, 1500))
    linked = hit.any(axis=1)
    want = {ids[i]: ((hit[i] * copies).sum(), least[group[i]]) for i in np.flatnonzero(linked)}
    found = vectors.cell_links(0.98)(("c", "0-0"), frame)
    assert {r.id: (r.links, r.low) for r in found.itertuples()} == want


def test_near_vectors_repeated_and_nameless(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.001], 1), (None, None, 1)]
    got = sorted(map(str, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == sorted(map(str, [
        "Row(vec_id=5, n_links=2, component_id=5, kept=True)", "Row(vec_id=5, n_links=2, component_id=5, kept=True)",
        "Row(vec_id=None, n_links=2, component_id=5, kept=False)", "Row(vec_id=None, n_links=0, component_id=None, kept=True)"]))
