"""Column functions. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from emberwatch.model import FORENSIC_FIELDS, INTEGRITY_ORDER, MAX_NOTE_WORDS


def basename(path: Column, missing: str | None = None) -> Column:
    """Last path component, accepting either slash; empty and null give `missing`."""
    last = F.substring_index(F.translate(path, "/", "\\"), "\\", -1)
    return F.when((path.isNull()) | (path == ""), F.lit(missing)).otherwise(last)


def present(c: Column) -> Column:
    """Null for the empty string: 'truthy' strings only."""
    return F.when(c != "", c)


def once(c: Column) -> Column:
    """A column evaluated a single time however often it is read.

    The optimizer copies a plain expression into every filter and projection that
    names it; the output of a generator is never copied.
    """
    return F.explode(F.array(c))


def round_exact(x: Column, digits: int) -> Column:
    """A non-negative double under 2**50 to `digits` digits, by its exact binary value and half to even.

    Spark rounds the shortest decimal text of a double instead, which moves values
    such as 0.925 (stored slightly above it) the other way, and ties away from zero.
    """
    bits = F.least(F.lit(60), F.lit(52) - F.floor(F.log2(F.greatest(x, F.lit(2.0 ** -8)))))
    unit = F.pow(F.lit(2.0), bits).cast("bigint").cast("decimal(19,0)")
    scaled = (x * F.pow(F.lit(2.0), bits)).cast("bigint").cast("decimal(19,0)") * F.lit(10 ** digits).cast(f"decimal({digits + 1},0)")
    rest = scaled % unit
    whole = ((scaled - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    return (whole + up.cast("int")) / F.lit(10.0 ** digits)


def word_count(text: Column) -> Column:
    """Words separated by any Unicode white space or separator control."""
    return F.size(F.filter(F.split(text, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"), lambda w: w != ""))


def note_accepted(note: Column, limit: int = MAX_NOTE_WORDS) -> Column:
    return word_count(F.coalesce(note, F.lit(""))) <= limit


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def iso_millis_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def pattern_escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def uuid5_url(name: Column) -> Column:
    """RFC 4122 version-5 identifier in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


# -- hashes and indicators ----------------------------------------------------

def parse_hashes(raw: Column) -> Column:
    """`SHA256=..,MD5=..` to a map with lower-case keys; a repeated key keeps its last value."""
    parts = F.filter(F.split(raw, ","), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"),
            F.trim(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("v"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: F.array_position(F.slice(keys, p["i"] + 2, F.size(keys)), p["k"]) == 0,
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def best_hash(hashes: Column) -> Column:
    return F.coalesce(hashes["sha256"], hashes["sha1"], hashes["md5"])


# IPv4 ranges that are not public (first address, prefix length),
# and the two addresses inside them that are.
NON_PUBLIC_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)
PUBLIC_V4_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
# IPv6 prefixes that are not public, as leading text of the compressed form.
NON_PUBLIC_V6 = r"^(::1?$|::ffff:|64:ff9b:1:|100:0*:|2001:db8:|2001:0*10:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def _v4_number(ip: Column) -> Column:
    octet = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("bigint")
    return octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)


def _v4_const(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return a * 16777216 + b * 65536 + c * 256 + d


def classify_indicator(value: Column) -> Column:
    """`ip`, `hash` or `domain`; null for non-public addresses and anything else."""
    v = F.trim(value)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    is_v4 = v.rlike(rf"^{octet}(\.{octet}){{3}}$")
    number = _v4_number(v)
    inside = F.lit(False)
    for start, bits in NON_PUBLIC_V4:
        lo = _v4_const(start)
        inside = inside | number.between(lo, lo + 2 ** (32 - bits) - 1)
    private = inside & ~v.isin(*PUBLIC_V4_EXCEPTIONS)
    is_v6 = v.rlike(r"(?i)^(?=.*:.*:)[0-9a-f:]+(%\w+)?$") & ~v.rlike(r":::|::.*::")
    is_hash = F.length(v).isin(32, 40, 64) & v.rlike("^[0-9a-fA-F]+$")
    is_domain = (
        F.contains(v, F.lit(".")) & ~F.contains(v, F.lit(" ")) & ~F.contains(v, F.lit("/")) & (F.length(v) < 254)
    )
    return (
        F.when(is_v4, F.when(~private, F.lit("ip")))
        .when(is_v6, F.when(~F.lower(v).rlike(NON_PUBLIC_V6), F.lit("ip")))
        .when(is_hash, F.lit("hash"))
        .when(is_domain, F.lit("domain"))
    )


def abuse_verdict(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unknown")).when(score >= 90, F.lit("malicious"))
        .when(score >= 25, F.lit("suspicious")).otherwise(F.lit("clean"))
    )


def vendor_verdict(flagged: Column) -> Column:
    return (
        F.when(flagged.isNull(), F.lit("unknown")).when(flagged >= 3, F.lit("malicious"))
        .when(flagged > 0, F.lit("suspicious")).otherwise(F.lit("clean"))
    )


VERDICT_ORDER = ("malicious", "suspicious", "unknown", "clean")


def worst_verdict(verdict: Column, available: Column) -> Column:
    """Aggregate: the worst verdict among available providers, `unknown` without any."""
    rank = F.array_position(F.lit(list(VERDICT_ORDER)), verdict).cast("int")
    worst = F.min(F.when(available & (rank > 0), rank))
    return F.coalesce(F.get(F.lit(list(VERDICT_ORDER)), worst - 1), F.lit("unknown"))


def integrity_rank(level: Column) -> Column:
    """0-based rank of a known integrity level, else null."""
    pos = F.array_position(F.lit(list(INTEGRITY_ORDER)), F.lower(level)).cast("int")
    return F.when(pos > 0, pos - 1)


def forensic_fields(raw: Column) -> Column:
    """Friendly-named map of the forensic keys that are present and non-empty."""
    names = F.create_map(*[F.lit(x) for kv in FORENSIC_FIELDS.items() for x in kv])
    kept = F.map_filter(raw, lambda k, v: k.isin(*FORENSIC_FIELDS) & v.isNotNull() & (v != ""))
    return F.transform_keys(kept, lambda k, v: names[k])


# -- encoded text -------------------------------------------------------------

def base64_runs(text: Column) -> Column:
    """Substrings worth decoding: clean length, some variety, not a bare digest."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"), F.lit(1))
    return F.filter(
        runs,
        lambda r: (F.length(r) % 4 == 0)
        & ~(r.rlike(r"(?i)^[0-9a-f]+$") & (F.length(r) <= 64))
        & (F.size(F.array_distinct(F.split(r, ""))) >= 8),
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, for which the value is evaluated once however often it is named: a variable is not copied."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_utf16(data: Column) -> Column:
    """Whether over a quarter of the bytes are zeros at odd positions, of more than four bytes."""
    size = F.length(data)
    zeros = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\0"), F.lit("")))
    # A character a byte. Most texts have too few zeros at any position, and their odd bytes are not picked out.
    return (size > 4) & _with(F.decode(data, "ISO-8859-1"), lambda text: F.when(
        zeros(text) > size / 4, zeros(F.regexp_replace(text, "(?s).(.)?", "$1")) > size / 4).otherwise(F.lit(False)))


def base64_decode_text(run: Column) -> Column:
    """Struct (text, is_utf16, printable) of one base64 run; null where it does not decode."""

    def described(text: Column, utf16: Column) -> Column:
        printable = F.length(F.regexp_replace(text, r"[^\t\n\r\x20-\x7e¡-￿]+", ""))
        return F.struct(text.alias("text"), utf16.alias("is_utf16"),
                        (printable / F.greatest(F.length(text), F.lit(1)) > 0.8).alias("printable"))

    decoded = lambda data, utf16: F.when(utf16, F.decode(data, "UTF-16LE")).otherwise(F.decode(data, "UTF-8"))
    return _with(F.try_to_binary(run, F.lit("base64")), lambda data: F.when(data.isNotNull(), _with(
        _is_utf16(data), lambda utf16: _with(decoded(data, utf16), lambda text: described(text, utf16)))))


def techniques_from_tags(tags: Column) -> Column:
    """Sorted distinct technique ids named by `attack.t1234[.001]` tags."""
    ids = F.transform(tags, lambda t: F.upper(F.regexp_extract(F.trim(t), r"(?i)^attack\.(t\d{4}(?:\.\d{3})?)$", 1)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda t: t != "")))
