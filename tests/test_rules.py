import re

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.literals import required_literals
from emberwatch.functions.predicates import field_test, glob_match
from emberwatch.model import PROMOTED
from emberwatch.operators.matching import Rule, match_rules, read_rules, rules_frame, rules_not_fired, shipped_rules

PS, CMD = r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe", r"C:\Windows\System32\cmd.exe"
CASES = [  # (event, rules that must fire among others)
    (dict(image=CMD, parent_image=r"C:\Office\WINWORD.EXE"), {"SYS-001"}),
    (dict(image=PS, command_line="powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwA="), {"SYS-002"}),
    (dict(image=r"C:\x\vssadmin.exe", command_line="VSSADMIN delete SHADOWS /all"), {"SYS-004"}),
    (dict(image=r"C:\Users\Public\svchost.exe"), {"SYS-006", "SYS-007"}),
    (dict(image=r"C:\Windows\System32\rundll32.exe", command_line="rundll32"), {"SYS-008"}),
    (dict(image=r"C:\w\rundll32.exe"), {"SYS-008"}),
    (dict(event_id=10, TargetImage=r"C:\Windows\System32\lsass.exe", GrantedAccess="0x1010"), {"SYS-010", "SYS-041", "SYS-206"}),
    (dict(event_id=3, image=r"C:\t\nc.exe", DestinationPort="4444"), {"SYS-021"}),
    (dict(event_id=13, TargetObject=r"HKU\S\SOFTWARE\Microsoft\Windows\CurrentVersion\Run\x"), {"SYS-030"}),
    (dict(image=r"C:\w\netsh.exe", command_line="netsh advfirewall firewall add rule name=x dir=in action=allow"), {"SYS-096"}),
    (dict(image=r"C:\w\wevtutil.exe", command_line="wevtutil cl Security"), {"SYS-097"}),
    (dict(image=r"C:\t\rar.exe", command_line="rar a -hpsecret -psecret out.rar x"), {"SYS-098"}),
    (dict(image=r"C:\t\rclone.exe", command_line="rclone copy C:\\data remote:bucket"), {"SYS-117", "SYS-143"}),
    (dict(event_id=11, TargetFilename=r"C:\Users\a\HOW_TO_DECRYPT.txt"), {"SYS-080"}),
    (dict(event_id=22, QueryName="evil.duckdns.org"), {"SYS-124"}),
    (dict(event_id=17, PipeName=r"\0123456789abcdef"), {"SYS-219"}),
    (dict(event_id=7, image=r"C:\w\lsass.exe", ImageLoaded=r"\\srv\share\x.dll"), {"SYS-215"}),
    (dict(image=PS, parent_image=r"C:\Windows\explorer.exe", command_line="powershell -ep bypass -w hidden -c x"), {"SYS-152"}),
    (dict(command_line="del /f /s /q C:\\Users\\bob\\Documents\\x"), {"SYS-167"}),
    (dict(image=CMD, command_line="whoſami /all & net user"), {"SYS-149"}),
    (dict(event_id=16, ConfigurationFileHash="SHA256=1"), {"SYS-191"}),
    (dict(event_id=2, image=r"C:\t\evil.exe"), {"SYS-129"}),
    (dict(image=r"C:\w\notepad.exe", command_line="notepad a.txt"), set()),
    (dict(event_id=3, image=r"C:\p\chrome.exe", DestinationPort="4444"), set()),
]


def expected(event):
    """Rule ids a plain reading of the rules gives."""
    fired = set()
    for rule in shipped_rules():
        if rule.event_id != event.get("event_id", 1):
            continue
        results = []
        for spec, values in rule.detection.items():
            name, *mods = spec.split("|")
            actual = event.get(name) if name not in PROMOTED or name in event else None
            ok = False
            if actual is not None:
                for v in values if isinstance(values, list) else [values]:
                    a, low = actual.lower(), v.lower()
                    op = next((m for m in mods if m != "not"), "equals")
                    ok |= {"equals": a == low, "contains": low in a, "startswith": a.startswith(low), "endswith": a.endswith(low),
                           "re": op == "re" and re.search(v, actual, re.I) is not None}[op]
            results.append(ok != ("not" in mods))
        if (all if rule.condition == "all" else any)(results):
            fired.add(rule.id)
    return fired


def test_shipped_rules_fire_as_read(spark, make_events):
    fired = {}
    for r in match_rules(make_events([e for e, _ in CASES]), shipped_rules()).collect():
        fired.setdefault(r.seq, set()).add(r.rule_id)
    for i, (event, must) in enumerate(CASES):
        assert must <= fired.get(i, set()), event
        assert fired.get(i, set()) == expected(event), event


def test_detection_carries_rule_metadata(make_events):
    row = match_rules(make_events([CASES[0][0]]), shipped_rules()).filter("rule_id = 'SYS-001'").first()
    assert (row.severity, row.attack, row.source) == ("high", ["T1566.001", "T1059"], 0)


def test_every_gate_is_implied_by_its_pattern():
    texts = [e.get(k, "") for e, _ in CASES for k in ("command_line", "image", "TargetFilename", "TargetObject", "PipeName")]
    for rule in shipped_rules():
        for spec, values in rule.detection.items():
            if "re" in spec.split("|")[1:]:
                for p in values if isinstance(values, list) else [values]:
                    needed = required_literals(p)
                    for t in texts:
                        if needed and re.search(p, t, re.I):
                            assert any(n in t.lower() for n in needed), (p, t)


@pytest.mark.parametrize("pattern, wanted", [
    (r"\bvssadmin\b.*\bdelete\b", ["vssadmin"]), (r"(?=.*\bsave\b)(?=.*hklm\\sam)", ["hklm\\sam"]), (r"abc|\d+", []),
    (r"(foobar|bazqux)\s", ["bazqux", "foobar"]), (r"x?y*", []),
])
def test_required_literals(pattern, wanted):
    assert required_literals(pattern) == wanted


def test_missing_field_is_false_before_negation(make_events):
    rows = make_events([dict(), dict(command_line="abc")]).select(
        "seq", field_test("command_line|contains", "b").alias("plain"), field_test("command_line|contains|not", "b").alias("negated"))
    assert [(r.plain, r.negated) for r in rows.orderBy("seq").collect()] == [(False, True), (True, False)]


def test_unknown_operator_is_refused():
    with pytest.raises(ValueError):
        field_test("image|near", "x")


def test_empty_detection_never_fires(make_events):
    assert match_rules(make_events([dict()]), [Rule("E", 1, "low", "t", {})]).count() == 0


def test_glob(spark):
    df = spark.createDataFrame([("evil.exe",), ("EVIL.dll",), ("my evil.exe",)], "s string")
    hit = lambda p: [r[0] for r in df.select(glob_match(F.col("s"), p)).collect()]
    assert hit("*.exe") == [True, False, True]
    assert hit("evil*") == [True, True, False]
    assert hit("*evil*") == [True, True, True]
    assert hit("ev?l.exe") == [True, False, False]
    assert hit(["evil.exe", "*.dll"]) == [True, True, False]


def test_read_rules_skips_bad_and_disabled(tmp_path):
    (tmp_path / "a.json").write_text('{"id": "A", "event_id": 1, "severity": "low", "title": "t", "detection": {"image": "x"}}')
    (tmp_path / "b.json").write_text('{"id": "B", "event_id": 1, "title": "t", "enabled": false}')
    (tmp_path / "c.json").write_text("{")
    assert [r.id for r in read_rules(str(tmp_path))] == ["A"]


def test_rules_not_fired(spark, make_events):
    rules = shipped_rules()
    left = rules_not_fired(rules_frame(spark, rules), match_rules(make_events([CASES[0][0]]), rules))
    assert left.count() == len(rules) - len(expected(CASES[0][0]))
