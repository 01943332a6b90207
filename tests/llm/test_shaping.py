import base64
import hashlib
import json
import random

import duckdb
import numpy as np
import pytest
from made_texts import prose
from pyspark.sql import functions as F

from emberwatch.llm import chat, html, mixing, sketches
from emberwatch.llm.queries import _op5_sql, op5_source_mixing, op8_tool_calls


def test_sketch_keeps_every_hash_below_the_threshold(spark):
    texts = [prose(i, n) for i, n in enumerate((0, 1, 4, 5, 6, 300, 5000))] + ["a\tb \n c\x0bd\x0ce f", " lead trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["hs"] for r in df.withColumn("h", sketches.word_hashes("text")).withColumn(
        "hs", sketches.kept_hashes("h")).collect()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame(
        [(w,) for w in {w for t in texts for w in t.split()}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        runs = [words[k:k + 5] for k in range(max(1, len(words) - 4))] if words else []
        rows = spark.createDataFrame([([hashes[w] for w in r],) for r in runs] or [([],)], "h array<long>")
        all_ = [r[0] for r in rows.select(F.xxhash64(*(F.get("h", F.lit(k)) for k in range(5)))).collect()] if runs else []
        assert got[i] == sorted({h >> 31 for h in all_ if 0 <= h < 1 << 63})


def test_merged_sketches_estimate_containment(spark):
    long, short = prose(1, 6000), " ".join(prose(1, 6000).split()[1000:2600])
    df = spark.createDataFrame([(long, short)], "a string, b string").select(
        *(sketches.word_hashes(c).alias(f"h{c}") for c in "ab"))
    df = df.select(*(sketches.kept_hashes(f"h{c}").alias(c) for c in "ab"))
    row = df.select(sketches.containment("b", "a").alias("c"), (F.size("a") / 6000).alias("share")).first()
    assert row["c"] == 1.0 and 0.45 < row["share"] < 0.55


@pytest.mark.parametrize("cell", [2, 256])
def test_edited_texts_follow_the_neighbours(spark, monkeypatch, cell):
    monkeypatch.setattr(sketches, "CELL_IDS", cell)
    rng = random.Random(8)
    ids = rng.sample(range(-50, 3000), 40)
    docs = [(i, prose(i, rng.choice([0, 1, 3, 40, 200])) + "é" * rng.randrange(3)) for i in ids]
    docs[5] = (docs[5][0], None)
    got = {r["doc_id"]: r for r in sketches.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    docs.sort(key=lambda d: -d[0])
    assert len(got) == 40
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert got[i]["n_chars"] == len(text)
        if edited == text:
            assert got[i]["near_edited"] == 1.0 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]


def unpacked(fp):
    return set() if fp.startswith("=") else {fp_bytes for fp_bytes in np.frombuffer(base64.b64decode(fp), ">u4").tolist()}


def jaccard(a, b, x, y):
    return len(a & b) / len(a | b) if a | b else float(x == y)


def test_likeness_is_that_of_the_fingerprints_and_near_the_true_one(spark):
    """Every likeness follows from the emitted fingerprints; its error against all shingles falls with the text's length."""
    rng = random.Random(12)
    docs = [(i, prose(i % 90, n)) for i in range(180) for n in [rng.choice([3, 8, 30, 200, 1500])]]
    got = {r["doc_id"]: r for r in sketches.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts, errors = dict(docs), {}
    shingles = lambda t: {tuple(w[k:k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))}
    for i, text in docs:
        r, after = got[i], texts[(i - 1) % len(docs)]
        fp, edited_fp, next_fp = r["fingerprint"], r["edited_fingerprint"], got[(i - 1) % len(docs)]["fingerprint"]
        assert r["near_edited"] == jaccard(unpacked(fp), unpacked(edited_fp), fp, edited_fp)
        assert r["near_next"] == jaccard(unpacked(fp), unpacked(next_fp), fp, next_fp)
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        true = jaccard(shingles(text), shingles(edited), text, edited)
        errors.setdefault(len(text.split()), []).append(abs(true - r["near_edited"]))
    mean = {n: sum(e) / len(e) for n, e in errors.items()}
    assert mean[1500] < 0.02 and mean[200] < 0.06 and mean[30] < 0.16
    assert sum(len(r["fingerprint"]) for r in got.values()) < sum(len(t) for t in texts.values()) / 2


def test_ids_at_both_ends_of_a_long(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    docs = [(high, "a b c d e f"), (0, "g h i j k l"), (low, "m n o p q r"), (None, "s t u v w x")]
    got = {r["doc_id"]: r["edited_sha256"] for r in sketches.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: hashlib.sha256((t[:6] + docs[(k + 1) % 4][1][:5]).encode()).hexdigest() for k, (i, t) in enumerate(docs)}
    assert got == want


def test_fingerprints_of_odd_documents(spark, odd_docs, no_docs):
    got = sketches.fingerprinted(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    by_text = {}
    for r in odd_docs.select("doc_id", "text").collect():
        by_text.setdefault(r["text"] or "", set()).update(got[got.doc_id == r["doc_id"]].fingerprint)
    assert all(len(v) <= 1 for v in by_text.values())
    assert sketches.fingerprinted(no_docs).count() == 0
    one = sketches.fingerprinted(odd_docs.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0  # after the last comes the first: itself


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 5), ("b", "x", "1", 10_000)],
                                   "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(weights={"lang": {"y": 3}}, budget_share=0.1)
    got = {(r[0], r[1], r[2]): r["budget"] for r in mixing.leaf_budgets(leaves, mix).collect()}
    # 1101.5 in all, half to each domain; y can give 5, so x gets 545.75: 10 of the small source, the rest of its sibling.
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 535.75, ("a", "y", "1"): 5, ("b", "x", "1"): 550.75}
    short = mixing.Mix(weights={"domain": {"a": 1000}}, budget_share=0.5)
    got = {(r[0], r[1], r[2]): r["budget"] for r in mixing.leaf_budgets(leaves, short).collect()}
    assert got["b", "x", "1"] == 5507.5 - 1015 and got["a", "x", "2"] == 1000
    none = mixing.Mix(weights={"domain": {"a": 0}}, budget_share=0.5)
    assert {r["domain"] for r in mixing.leaf_budgets(leaves, none).collect()} == {"b"}


def test_mix_equals_its_sql_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path)
    more = [(100 + i, prose(i, i % 50), ["en", "de", "fr"][i % 3], f"src{i % 7 if i % 3 else 0}", 0) for i in range(400)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is null or doc_id <> 7")
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    got = op5_source_mixing(spark, path)
    want = con.execute(f"select {', '.join(got.columns)} from ({_op5_sql()})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert len(want) == got.count() > 400
    mix = mixing.Mix(budget_share=1.7, max_epochs=2, seed=3)
    drawn = mixing.draw(odd_docs, F.lit("all"), mix)
    assert drawn.columns == odd_docs.columns
    copies = mixing.mixed(odd_docs, F.lit("all"), mix)
    assert drawn.count() == copies.agg(F.sum("copies")).first()[0]
    assert mixing.draw(no_docs, F.lit("all"), mix).count() == 0


@pytest.mark.parametrize("source, want", [
    (None, None), ("", ""), ("<p>One<p>Two <b>bold</i> x</b><div>Div</div>tail", "One\n\nTwo bold x\n\nDiv\ntail"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li value=7>y<li>z</ol>", "- a\n- b\n  - c\n- d\n\n3. x\n7. y\n8. z"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td align=right>3<tr><td>kiwi fruit<td align=right>12</table>after",
     "   Name     Qty\napple         3\nkiwi fruit   12\n\nafter"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell here</table>", "a  b\n   c\nwide cell here"),
    ("<table><tr>oops<td>1</td></tr></table>", "oops\n\n1"),
    ("<table><tr><td>x<br>y<td><ul><li>p<li>q</ul></table>", "x  - p\ny  - q"),
    ("<title>t</title><p hidden>n</p><p style='color:red; display : none'>n</p>a<script>'</p>'</script><!-- c -->b", "ab"),
    ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>", "s\nt\nyes"),
    ("<pre>a\n  b\n\nc</pre>x<br>y<br><br>z", "a\n  b\n\nc\n\nx\ny\n\nz"),
    ("a &lt;b&gt; &copy;&nbsp;c < d", "a <b> © c < d"), ("cut <b", "cut"), ("cut <p>x</", "cut\n\nx</"),
    ("<td>no table</td> ok", "no table ok"), ("<dl><dt>T<dd>D</dl>", "T\n    D"), ("<h1>A<h2>B</h2>c", "A\n\nB\n\nc"),
    ("<select><option>a<option>b</select>", "a\nb"), ("x</p>y", "x\n\ny"), ("<body hidden>x", ""),
])
def test_pages_read_as_laid_out(source, want):
    assert html.visible_text(source) == want


def test_extraction_survives_anything(spark):
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<script>", "<", ">", "\"", "'", "x", "&",
            "<b a=\"", "</td>", "<caption>", "<body>", "</body>", "<select>", "<option>", "<!--", "-->", "<title>", "<dd>", "</", "<col>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for p in pages:
        html.visible_text(p)
    assert html.visible_text("<div>" * 50_000 + "deep") == "deep"
    rows = [(1, p, "t") for p in pages[:50]] + [(None, None, "t"), (1, "", "t")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == 52 and sum(r["text"] is None for r in got) == 1
    assert all(r["n_lines"] == (len(r["text"].split("\n")) if r["text"] else 0) for r in got)
    assert html.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


SCHEMAS = {"f": {"a": chat.Parameter("integer", True, least=0, most=9), "b": chat.Parameter("string", choices=("x", "y")),
                 "c": chat.Parameter("number")}}


@pytest.mark.parametrize("source, want", [
    ('{"a": 3, "b": "x"}', []), ('{"b": 1}', ["a: missing", "b: not string"]), ('{"a": true}', ["a: not integer"]),
    ('{"a": 10, "z": 1}', ["a: out of range", "z: not a parameter"]), ('{"a": 1, "b": "q"}', ["b: not a choice"]),
    ('{"a": 1.0, "c": 2.5}', []), ("[1]", ["arguments: not an object"]), ("{", ["arguments: not JSON"]), (None, ["arguments: not JSON"]),
    ('{"a": 1, "a": 2}', ["arguments: not JSON"]), ('{"a": NaN}', ["arguments: not JSON"]),
])
def test_arguments_against_schemas(source, want):
    value, error = chat.parsed(source)
    assert ([error] if error else chat.faults("f", value, SCHEMAS)) == want


@pytest.mark.parametrize("source", ['{"query": "\\ud800"}', '{"\\udc00": 1}', '{"limit": 1e999}', '[' * 100_000, '{"a": -1e400}'])
def test_json_that_is_no_text_or_number_is_an_error(spark, source):
    assert chat.parsed(source) == (None, "arguments: not JSON")
    calls = spark.createDataFrame([(1, 1, "c", "search", source, [])], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    (row,) = chat.exchanges(calls, results, {"search": {}}).collect()
    assert row["errors"] == ["arguments: not JSON"] and not row["valid"]


def test_json_is_canonical():
    for a, b in (('{"b":1,"a":[1.0,{"y":null,"x":"é"}]}', '{"a":[1,{"x":"é","y":null}],"b":1}'), ('{"z":"a\\u0062"}', '{"z":"ab"}')):
        assert chat.canonical(chat.parsed(a)[0]) == b


def test_calls_are_linked_and_ordered(spark):
    call = lambda turn, cid, needs=(), name="f", args='{"a":1}', conv=1: (conv, turn, cid, name, args, list(needs), "extra")
    calls = [call(1, "A"), call(2, "B", ["A", "A", "nowhere"]), call(3, "C", ["A", "B"]), call(4, "D", ["E"]), call(5, "E", ["D"]),
             call(6, "F", ["F"]), call(7, "B", ["C"]), call(7, None), call(1, "A", conv=2), call(1, "G", conv=None),
             call(8, "H", ["D"]), call(9, "I", args="{")]
    results = [(1, 2, "A", "ra", "extra"), (1, 3, "B", "rb", "e"), (1, 9, "B", "rb2", "e"), (1, 2, "C", "early", "e"),
               (1, 5, "X", "lost", "e"), (1, 5, None, "none", "e"), (1, 7, "D", None, "e"), (1, 7, "E", "re", "e")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, n string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string, status string")
    got = {(x["conv_id"], x["call_id"], x["status"]): x for x in chat.exchanges(c, r, SCHEMAS).collect()}
    level = {k[1]: v["level"] for k, v in got.items() if k[0] == 1 and v["level"] is not None}
    assert level == {"A": 0, "B": 1, "C": 2, "F": 0, "I": 0}
    assert {k[1:] for k in got if k[0] == 1} == {
        ("A", "linked"), ("B", "linked"), ("B", "repeated"), ("B", "repeated result"), ("C", "out of order"), ("D", "cycle"),
        ("E", "cycle"), ("F", "unanswered"), ("H", "cycle"), ("I", "unanswered"), ("X", "orphan"), (None, "unanswered"), (None, "orphan")}
    assert got[1, "A", "linked"]["message"] == '{"call":{"arguments":{"a":1},"id":"A","name":"f"},"id":"A","result":"ra"}'
    assert got[1, "I", "unanswered"]["errors"] == ["arguments: not JSON"] and not got[1, "I", "unanswered"]["valid"]
    assert json.loads(got[1, "X", "orphan"]["message"])["call"] is None and got[1, "X", "orphan"]["valid"] is None
    assert (2, "A", "unanswered") in got and (None, "G", "unanswered") in got
    assert chat.exchanges(c.limit(0), r.limit(0), SCHEMAS).count() == 0


def test_levels_match_the_longest_paths(spark):
    rng = random.Random(6)
    needs = {(c, i): sorted({rng.randrange(max(0, i - 6), i) for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))} if i else set())
             for c in range(3) for i in range(120)}
    needs.update({(9, i): [i - 1] if i else [] for i in range(200)} | {(8, 0): [2], (8, 1): [0], (8, 2): [1], (8, 3): [1, 4], (8, 4): []})
    want = {}
    for (c, i), below in needs.items():
        if c != 8:
            want[c, str(i)] = 1 + max((want[c, str(b)] for b in below), default=-1)
    want[8, "4"] = 0
    rows = [(c, str(i), [*map(str, n), "missing", str(i)]) for (c, i), n in needs.items()]
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>"))
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got.collect()} == want


def test_pipeline_against_the_operators(spark, tmp_path):
    import corpus_pipeline

    base = [(i, prose(i, 80), "en", f"src{i % 5}", 0) for i in range(60)]
    rows = base + [(200 + i, base[i][1], "en", "src1", 0) for i in range(10)] + [(300, "12 34", "en", "src1", 0), (301, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) <= set(range(60)) and len(got) >= 0.85 * 60
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_tool_traffic_carries_whole_turns(spark, tmp_path):
    rows = [(conv, 0, "system", f"rules {conv}") for conv in range(6, 9)]
    rows += [(conv, turn, "user" if turn % 2 else "assistant", prose(10 * conv + turn, 30))
             for conv in range(6, 9) for turn in range(1, 10)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = op8_tool_calls(spark, str(tmp_path)).collect()
    for conv, turn, role, text in rows:
        have = [json.loads(r["message"]) for r in got if r["conv_id"] == conv]
        if role == "assistant":
            assert sum(text in ((m["call"] or {}).get("arguments") or {}).values() for m in have) == 1, (conv, turn)
        else:
            assert sum(m["result"] == text and (role == "user" or m["id"] is None) for m in have) == 1, (conv, turn)
    levels = {(r["conv_id"], r["call_id"]): (r["level"], r["status"]) for r in got if r["turn"] is not None}
    assert [levels[6, f"call_{t}"][0] for t in (2, 4, 6, 8)] == [0, 1, 2, 3]
    assert {levels[7, f"call_{t}"] for t in (2, 4, 6, 8)} == {(None, "cycle")}


def test_likeness_of_short_texts_is_exact(spark):
    docs = [(i, prose(i // 2, n) + (" end" if i % 2 else "")) for i, n in enumerate(n for n in (1, 5, 6, 8, 12, 20, 50, 200) for _ in "ab")]
    got = {r["doc_id"]: r for r in sketches.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    shingles = lambda t: {tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for i, text in docs:
        after = docs[i - 1][1]
        half = len(text) // 2
        own, edited, next_ = (shingles(t) for t in (text, text[:len(text) - half] + after[:half], after))
        assert got[i]["near_edited"] == pytest.approx(len(own & edited) / len(own | edited)), i
        assert got[i]["near_next"] == pytest.approx(len(own & next_) / len(own | next_)), i
        assert got[i]["contained_edited"] == pytest.approx(len(own & edited) / len(own)), i


def test_further_calls_and_results_keep_what_they_say(spark):
    calls = [(1, 1, "A", "f", '{"a":1}', []), (1, 1, "A", "f", '{"a":1}', []), (1, 3, "A", "f", '{"a":2}', ["B"]),
             (1, 5, "A", "f", '{"a":99}', None), (1, 5, "A", "f", '{"a":99}', None)]
    results = [(1, 2, "A", "one"), (1, 4, "A", "two"), (1, 6, "A", "three"), (1, 6, "A", "three")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = chat.exchanges(c, r, SCHEMAS).collect()
    rows = sorted((x["status"], x["turn"] or 0, x["n"], str(x["errors"]), json.loads(x["message"])["result"] or "") for x in got)
    assert rows == [("linked", 1, 1, "[]", "one"), ("repeated", 1, 1, "[]", ""), ("repeated", 3, 1, "[]", ""),
                    ("repeated", 5, 2, "['a: out of range']", ""), ("repeated result", 0, 1, "None", "two"),
                    ("repeated result", 0, 2, "None", "three")]
