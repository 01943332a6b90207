import base64
import random

from pyspark.sql import functions as F

from emberwatch.functions import scalars as sc


def described(data):
    utf16 = len(data) > 4 and sum(b == 0 for b in data[1::2]) > len(data) / 4
    text = data.decode("utf-16-le" if utf16 else "utf-8")
    shown = sum(c in "\t\n\r" or " " <= c <= "~" or "¡" <= c <= "￿" for c in text)
    return text, utf16, shown / max(1, len(text)) > 0.8


def test_decoded_runs(spark):
    """Zeros at even positions, an odd byte at the end, and shares on the boundary do not make UTF-16."""
    rng = random.Random(2)
    datas = [bytes(d) for d in ([65, 0, 66, 0], [65, 0, 66, 0, 67, 0], [0, 65, 0, 66, 0, 67], [0, 65, 0, 66, 0], [65, 0, 66, 67, 68, 69, 70, 0])]
    datas += ["né€\n".encode("utf-16-le") * 3, "né€\x01".encode() * 3, b""]
    datas += [bytes(rng.choice([0, 0, 65, 66, 10, 1, 127]) for _ in range(2 * rng.randrange(9))) for _ in range(400)]
    runs = spark.createDataFrame([(i, base64.b64encode(d).decode()) for i, d in enumerate(datas)] + [(-1, "no base64 %%"), (-2, None)], "i int, run string")
    got = {r.i: r.t for r in runs.select("i", sc.base64_decode_text(F.col("run")).alias("t")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    want = [described(d) for d in datas]
    assert [tuple(got[i]) for i in range(len(datas))] == want
    assert 0 < sum(w[1] for w in want) < len(want)


def test_a_run_is_decoded_once(spark):
    """Before, the run was decoded anew wherever its bytes or its text were named."""
    rows = spark.createDataFrame([("QUJD",)], "run string").select(sc.base64_decode_text(F.col("run")).alias("t"))
    plan = rows.select(F.md5("t.text"), "t.is_utf16", "t.printable")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_binary") + plan.count("unbase64") == 1
