"""On-disk values of PostgreSQL types as canonical text: one decoder per type, and a registry."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Mapping
from datetime import date, timedelta
from decimal import Decimal
from functools import lru_cache

import numpy as np

from pagewright.functions.varlena import External, frame_size, payload

Decoder = Callable[[bytes], str]

_EPOCH = date(2000, 1, 1).toordinal()
_DAY = 86_400_000_000


class Broken(ValueError):
    """The bytes are no value of the type."""


def _take(fmt: str, raw: bytes, at: int = 0):
    try:
        return struct.unpack_from("<" + fmt, raw, at)
    except struct.error as x:
        raise Broken(str(x)) from None


def _number(fmt: str) -> Decoder:
    return lambda raw: str(_take(fmt, raw)[0])


def bool_(raw: bytes) -> str:
    return "t" if _take("B", raw)[0] else "f"


def _float(fmt: str) -> Decoder:
    kind = np.float32 if fmt == "f" else np.float64

    def decode(raw: bytes) -> str:
        x = _take(fmt, raw)[0]
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "Infinity" if x > 0 else "-Infinity"
        if x == 0:
            return "-0" if math.copysign(1, x) < 0 else "0"
        sign, digits, exponent = Decimal(np.format_float_scientific(kind(x), unique=True, trim="-")).as_tuple()
        text = "".join(map(str, digits)).rstrip("0") or "0"
        power = exponent + len(digits) - 1
        lead = "-" if sign else ""
        if -4 <= power < (6 if fmt == "f" else 15):
            if power < 0:
                return lead + "0." + "0" * (-power - 1) + text
            return lead + (text.ljust(power + 1, "0") if len(text) <= power + 1 else text[: power + 1] + "." + text[power + 1 :])
        mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
        return f"{lead}{mantissa}e{'+' if power >= 0 else '-'}{abs(power):02d}"

    return decode


def numeric(raw: bytes) -> str:
    """Groups of four decimal digits, in a short or a long header."""
    head = _take("H", raw)[0]
    kind = head & 0xC000
    if kind == 0xC000:
        special = head & 0xF000
        return {0xC000: "NaN", 0xD000: "Infinity", 0xF000: "-Infinity"}.get(special, "NaN")
    if kind == 0x8000:
        negative, scale = bool(head & 0x2000), head >> 7 & 0x3F
        weight, at = (head & 0x3F) - (head & 0x40), 2
    else:
        negative, scale = kind == 0x4000, head & 0x3FFF
        weight, at = _take("h", raw, 2)[0], 4
    groups = _take(f"{(len(raw) - at) // 2}H", raw, at)
    if any(g > 9999 for g in groups):
        raise Broken("a group of digits is too large")
    whole = "".join(f"{groups[i] if i < len(groups) else 0:04d}" for i in range(weight + 1)).lstrip("0") or "0"
    fraction = "".join(f"{groups[i] if 0 <= i < len(groups) else 0:04d}" for i in range(weight + 1, weight + 2 + (scale + 3) // 4 + max(0, -weight - 1)))
    if weight < -1:
        fraction = "0000" * (-weight - 1) + "".join(f"{g:04d}" for g in groups)
    fraction = fraction[:scale].ljust(scale, "0")
    text = whole + ("." + fraction if scale else "")
    return "-" + text if negative and text.strip("0.") else text


def money(raw: bytes) -> str:
    cents = _take("q", raw)[0]
    return f"{'-' if cents < 0 else ''}${abs(cents) // 100:,}.{abs(cents) % 100:02d}"


def _civil(days: int) -> tuple[int, int, int]:
    """Proleptic Gregorian date of days since 2000-01-01, also outside Python's years."""
    era, of_era = divmod(days + 730_425, 146_097)  # days since 0000-03-01
    year_of_era = (of_era - of_era // 1460 + of_era // 36_524 - of_era // 146_096) // 365
    of_year = of_era - (365 * year_of_era + year_of_era // 4 - year_of_era // 100)
    month = (5 * of_year + 2) // 153
    day = of_year - (153 * month + 2) // 5 + 1
    month = month + 3 if month < 10 else month - 9
    return year_of_era + era * 400 + (month <= 2), month, day


def _date(days: int) -> tuple[str, str]:
    y, m, d = _civil(days)
    return (f"{y:04d}-{m:02d}-{d:02d}", "") if y > 0 else (f"{1 - y:04d}-{m:02d}-{d:02d}", " BC")


def date_(raw: bytes) -> str:
    days = _take("i", raw)[0]
    if days in (2**31 - 1, -(2**31)):
        return "infinity" if days > 0 else "-infinity"
    return "".join(_date(days))


def _clock(us: int) -> str:
    s, fraction = divmod(us, 1_000_000)
    text = f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    return text + (f".{fraction:06d}".rstrip("0") if fraction else "")


def time_(raw: bytes) -> str:
    return _clock(_take("q", raw)[0])


def _zone(seconds_west: int) -> str:
    east = -seconds_west
    sign, n = "-" if east < 0 else "+", abs(east)
    text = f"{sign}{n // 3600:02d}"
    if n % 3600:
        text += f":{n // 60 % 60:02d}" + (f":{n % 60:02d}" if n % 60 else "")
    return text


def timetz(raw: bytes) -> str:
    us, zone = _take("qi", raw)
    return _clock(us) + _zone(zone)


def timestamp(raw: bytes, suffix: str = "") -> str:
    us = _take("q", raw)[0]
    if us in (2**63 - 1, -(2**63)):
        return "infinity" if us > 0 else "-infinity"
    days, rest = divmod(us, _DAY)
    day, era = _date(days)
    return f"{day} {_clock(rest)}{suffix}{era}"


def interval(raw: bytes) -> str:
    us, days, months = _take("qii", raw)
    years, months = int(months / 12), int(math.fmod(months, 12))
    parts, negative = [], False
    for n, unit in ((years, "year"), (months, "mon"), (days, "day")):
        if n:
            plus = "+" if negative and n > 0 else ""
            parts.append(f"{plus}{n} {unit}{'' if n == 1 else 's'}")
            negative = n < 0
    if us or not parts:
        lead = "-" if us < 0 else "+" if negative else ""
        parts.append(lead + _clock(abs(us)))
    return " ".join(parts)


def uuid(raw: bytes) -> str:
    if len(raw) != 16:
        raise Broken("a uuid has 16 bytes")
    h = raw.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def bytea(raw: bytes) -> str:
    return "\\x" + raw.hex()


def tid(raw: bytes) -> str:
    high, low, item = _take("HHH", raw)
    return f"({high << 16 | low},{item})"


def inet(raw: bytes, cidr: bool = False) -> str:
    family, bits = _take("BB", raw)
    if family == 2 and len(raw) >= 6:
        text, full = ".".join(map(str, raw[2:6])), 32
    elif family == 3 and len(raw) >= 18:
        text, full = _ipv6(raw[2:18]), 128
    else:
        raise Broken("no address family")
    return f"{text}/{bits}" if cidr or bits != full else text


def _ipv6(raw: bytes) -> str:
    words = struct.unpack(">8H", raw)
    best, at = (0, -1), 0
    while at < 8:
        n = 0
        while at + n < 8 and words[at + n] == 0:
            n += 1
        if n > best[0]:
            best = (n, at)
        at += n or 1
    mapped = words[:5] == (0,) * 5 and words[5] in (0xFFFF, 0) and (words[5] or words[6])
    tail = [".".join(map(str, raw[12:]))] if mapped else [f"{w:x}" for w in words[6:]]
    shown = [f"{w:x}" for w in words[:6]] + tail
    if best[0] < 2:
        return ":".join(shown)
    n, at = best
    n = min(n, 6 - at) if mapped and at + n > 6 else n
    return ":".join(shown[:at]) + "::" + ":".join(shown[at + n :])


def _mac(raw: bytes) -> str:
    return ":".join(f"{b:02x}" for b in raw)


def bits(raw: bytes) -> str:
    n = _take("i", raw)[0]
    if n < 0 or (n + 7) // 8 > len(raw) - 4:
        raise Broken("fewer bytes than bits")
    return "".join(f"{b:08b}" for b in raw[4:])[:n]


def pg_lsn(raw: bytes) -> str:
    n = _take("Q", raw)[0]
    return f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"


def txid_snapshot(raw: bytes) -> str:
    n, low, high = _take("I4xQQ", raw) if len(raw) >= 24 and (len(raw) - 24) % 8 == 0 else _take("IQQ", raw)
    at = 24 if (len(raw) - 24) % 8 == 0 and len(raw) >= 24 else 20
    return f"{low}:{high}:" + ",".join(map(str, _take(f"{n}Q", raw, at)))


def oidvector(element: str) -> Decoder:
    def decode(raw: bytes) -> str:
        n = _take("i", raw, 12)[0]
        return " ".join(map(str, _take(f"{max(0, n)}{element}", raw, 20)))

    return decode


# ---- geometry ----

_f8 = _float("d")


def _coord(raw: bytes, at: int) -> str:
    return _f8(raw[at : at + 8])


def point(raw: bytes, at: int = 0) -> str:
    return f"({_coord(raw, at)},{_coord(raw, at + 8)})"


def _points(raw: bytes, at: int, n: int) -> str:
    return ",".join(point(raw, at + 16 * i) for i in range(n))


def path(raw: bytes) -> str:
    n, closed = _take("ii", raw)
    body = _points(raw, 12, n)
    return f"({body})" if closed else f"[{body}]"


def polygon(raw: bytes) -> str:
    return f"({_points(raw, 36, _take('i', raw)[0])})"


# ---- jsonb ----

_OFFSET, _TYPE = 0x0FFFFFFF, 0x70000000


def jsonb(raw: bytes) -> str:
    """The tree of a jsonb value as JSON text; strings are written as they are, not as entities."""
    return _json_container(raw, 0)


def _json_container(raw: bytes, at: int) -> str:
    head = _take("I", raw, at)[0]
    n = head & 0x0FFFFFFF
    is_object, is_array, scalar = bool(head & 0x20000000), bool(head & 0x40000000), bool(head & 0x10000000)
    if not (is_object or is_array):
        raise Broken("neither array nor object")
    count = n * 2 if is_object else n
    entries = _take(f"{count}I", raw, at + 4)
    base = at + 4 + 4 * count
    items, end = [], 0
    for e in entries:
        start = end
        end = e & _OFFSET if e & 0x80000000 else start + (e & _OFFSET)
        kind = e & _TYPE
        if end < start or base + end > len(raw):
            raise Broken("an entry ends before it starts")
        if kind == 0x00000000:
            items.append(json.dumps(raw[base + start : base + end].decode("utf-8", "replace"), ensure_ascii=False))
        elif kind == 0x10000000:
            padded = base + start + (-(base + start) % 4)
            value = payload(raw, padded)
            if not isinstance(value, bytes):
                raise Broken("a number without bytes")
            items.append(numeric(value))
        elif kind in (0x20000000, 0x30000000, 0x40000000):
            items.append({0x20000000: "false", 0x30000000: "true", 0x40000000: "null"}[kind])
        elif kind == 0x50000000:
            items.append(_json_container(raw, base + start + (-(base + start) % 4)))
        else:
            raise Broken("an entry of no kind")
    if scalar and is_array:
        return items[0]
    if is_array:
        return "[" + ", ".join(items) + "]"
    return "{" + ", ".join(f"{k}: {v}" for k, v in zip(items[:n], items[n:])) + "}"


# ---- text search ----


def tsvector(raw: bytes) -> str:
    n = _take("i", raw)[0]
    entries = _take(f"{n}I", raw, 4)
    base, out = 4 + 4 * n, []
    for e in entries:
        has_pos, length, at = e & 1, e >> 1 & 0x7FF, base + (e >> 12)
        word = "'" + raw[at : at + length].decode("utf-8", "replace").replace("\\", "\\\\").replace("'", "''") + "'"
        if has_pos:
            p = at + length + (-(at + length) % 2)
            spots = _take(f"{_take('H', raw, p)[0]}H", raw, p + 2)
            word += ":" + ",".join(f"{s & 0x3FFF}{'DCBA'[s >> 14].replace('D', '')}" for s in spots)
        out.append(word)
    return " ".join(out)


def tsquery(raw: bytes) -> str:
    """Infix text of a query; operands and operators come in prefix order."""
    n = _take("i", raw)[0]
    if n == 0:
        return ""
    base = 8 + 12 * n

    def item(i: int):
        at = 8 + 12 * i
        if at + 12 > len(raw) or i >= n:
            raise Broken("an item outside")
        return at

    def render(i: int, outer: int) -> str:
        at = item(i)
        if raw[at] == 1:
            weight, prefix = raw[at + 1], raw[at + 2]
            info = _take("I", raw, at + 8)[0]
            length, start = info & 0xFFF, base + (info >> 12)
            text = "'" + raw[start : start + length].decode("utf-8", "replace").replace("\\", "\\\\").replace("'", "''") + "'"
            marks = ("*" if prefix else "") + "".join(c for c, b in zip("ABCD", (8, 4, 2, 1)) if weight & b)
            return text + (":" + marks if marks else "")
        operator, distance, left = raw[at + 1], _take("h", raw, at + 2)[0], _take("I", raw, at + 4)[0]
        if operator == 1:
            inner = render(i + 1, 4)
            return "!" + inner
        mine = {2: 2, 3: 1, 4: 3}[operator]
        sign = {2: " & ", 3: " | ", 4: " <-> " if distance == 1 else f" <{distance}> "}[operator]
        text = render(i + left, mine) + sign + render(i + 1, mine)
        return f"( {text} )" if mine < outer else text

    return render(0, 0)


# ---- containers ----


def quote_item(text: str | None) -> str:
    if text is None:
        return "NULL"
    if text == "" or text.upper() == "NULL" or any(c in '{},"\\' or c.isspace() for c in text):
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return text


def quote_field(text: str | None) -> str:
    if text is None:
        return ""
    if text == "" or any(c in '(),"\\' or c.isspace() for c in text):
        return '"' + text.replace("\\", "\\\\").replace('"', '""') + '"'
    return text


def quote_bound(text: str) -> str:
    if text == "" or any(c in '()[],"\\' or c.isspace() for c in text):
        return '"' + text.replace("\\", "\\\\").replace('"', '""') + '"'
    return text


def element(raw: bytes, at: int, size: int, align: int, decode: Decoder, start: int = 0) -> tuple[str, int]:
    """Text of the value at a position (offsets for alignment count from `start`), and where it ends."""
    if size > 0:
        at += -(at - start) % align
        if at + size > len(raw):
            raise Broken("a value ends outside")
        return decode(raw[at : at + size]), at + size
    if size == -2:
        end = raw.index(0, at) if 0 in raw[at:] else len(raw)
        return decode(raw[at:end]), end + 1
    if at < len(raw) and not raw[at] & 1:
        at += -(at - start) % align
    n = frame_size(raw, at)
    value = payload(raw, at)
    if n < 1 or value is None:
        raise Broken("broken framing")
    if isinstance(value, External):
        raise Broken("an out-of-line value inside a container")
    return decode(value), at + n


def array(size: int, align: int, decode: Decoder, separator: str = ",") -> Decoder:
    """Decoder of arrays of a type: up to 6 dimensions, lower bounds, NULLs."""

    def decode_array(raw: bytes) -> str:
        dims, offset, _ = _take("iiI", raw)
        if dims == 0:
            return "{}"
        if not 0 < dims <= 6:
            raise Broken("no such number of dimensions")
        lengths, lows = _take(f"{dims}i", raw, 12), _take(f"{dims}i", raw, 12 + 4 * dims)
        total = math.prod(lengths)
        if any(n < 0 for n in lengths) or total > 8 * len(raw) + 8:
            raise Broken("more elements than bytes")
        if total == 0:
            return "{}"
        bitmap_at = 12 + 8 * dims
        # offsets in the stored value count its 4 framing bytes
        at = offset - 4 if offset else bitmap_at + (-(bitmap_at + 4) % 8)
        if offset and not bitmap_at + (total + 7) // 8 <= at <= len(raw):
            raise Broken("data before their bitmap")
        texts: list[str | None] = []
        for i in range(total):
            if offset and not raw[bitmap_at + i // 8] >> i % 8 & 1:
                texts.append(None)
                continue
            text, at = element(raw, at, size, align, decode, -4)
            texts.append(text)
        level = [quote_item(t) for t in texts]
        for n in reversed(lengths):
            level = ["{" + separator.join(level[i : i + n]) + "}" for i in range(0, len(level), n)]
        head = "".join(f"[{low}:{low + n - 1}]" for low, n in zip(lows, lengths)) + "=" if any(low != 1 for low in lows) else ""
        return head + level[0]

    return decode_array


def range_(size: int, align: int, decode: Decoder) -> Decoder:
    """Decoder of ranges: the flags are the last byte."""

    def decode_range(raw: bytes) -> str:
        flags = raw[-1]
        if flags & 1:
            return "empty"
        return _bounds(raw[:-1], 4, flags, size, align, decode)[0]

    return decode_range


def _bounds(raw: bytes, at: int, flags: int, size: int, align: int, decode: Decoder, start: int = -4) -> tuple[str, int]:
    lower = upper = ""
    if not flags & (8 | 32):
        text, at = element(raw, at, size, align, decode, start)
        lower = quote_bound(text)
    if not flags & (16 | 64):
        text, at = element(raw, at, size, align, decode, start)
        upper = quote_bound(text)
    left = "[" if flags & 2 and not flags & 8 else "("
    right = "]" if flags & 4 and not flags & 16 else ")"
    return f"{left}{lower},{upper}{right}", at


def multirange(size: int, align: int, decode: Decoder) -> Decoder:
    """Decoder of multiranges: number of ranges, offset items, flags, then the bounds of each."""

    def decode_multirange(raw: bytes) -> str:
        n = _take("I", raw, 4)[0]
        if n == 0:
            return "{}"
        items = _take(f"{n - 1}I", raw, 8)
        flags_at = 8 + 4 * (n - 1)
        data = flags_at + n
        data += -(data + 4) % align
        out, offset = [], 0
        for i in range(n):
            if i:
                e = items[i - 1]
                offset = e & 0x7FFFFFFF if e & 0x80000000 else offset + (e & 0x7FFFFFFF)
            out.append(_bounds(raw, data + offset, raw[flags_at + i], size, align, decode)[0])
        return "{" + ",".join(out) + "}"

    return decode_multirange


def composite(fields: list[tuple[int, int, Decoder]]) -> Decoder:
    """Decoder of row values: a tuple header, a bitmap, then the fields (size, alignment, decoder)."""

    def decode_row(raw: bytes) -> str:
        # a stored row keeps the 4 framing bytes in front of its header: offsets count from there
        natts = _take("H", raw, 14)[0] & 2047
        mask, hoff = _take("HB", raw, 16)
        at, texts = hoff - 4, []
        start = hoff - 4
        for i, (size, align, decode) in enumerate(fields):
            if i >= natts or (mask & 1 and not raw[19 + i // 8] >> i % 8 & 1):
                texts.append(None)
                continue
            text, at = element(raw, at, size, align, decode, start)
            texts.append(text)
        return "(" + ",".join(map(quote_field, texts)) + ")"

    return decode_row


def text(raw: bytes, encoding: str = "utf-8") -> str:
    """Text in the database's encoding; bytes that are none give hexadecimal text."""
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return bytea(raw)


def name_(raw: bytes) -> str:
    return text(raw.split(b"\0", 1)[0])


def char_(raw: bytes) -> str:
    b = _take("B", raw)[0]
    return "" if b == 0 else chr(b) if b < 128 else f"\\{b:03o}"


# The letters of access rights from bit 0 on.
_RIGHTS = "arwdDxtXUCTcsAm"


def aclitem(names: Mapping[int, str] | None = None) -> Decoder:
    """Decoder of access rights: `grantee=rights*/grantor`, with 8 or 4 bytes of rights; unknown roles by number."""
    names = names or {}

    def decode(raw: bytes) -> str:
        grantee, grantor = _take("II", raw)
        rights, half = (_take("Q", raw, 8)[0], 32) if len(raw) >= 16 else (_take("I", raw, 8)[0], 16)
        shown = "".join(c + ("*" if rights >> (i + half) & 1 else "") for i, c in enumerate(_RIGHTS) if rights >> i & 1 and i < half)
        who = "" if grantee == 0 else names.get(grantee, str(grantee))
        return f"{who}={shown}/{names.get(grantor, grantor)}"

    return decode


def enum(labels: Mapping[int, str]) -> Decoder:
    """Decoder of enums: the label of a member's oid, or the oid."""
    return lambda raw: labels.get(_take("I", raw)[0], str(_take("I", raw)[0]))


def registered(names: Mapping[int, str]) -> Decoder:
    """Decoder of reg* types: the object's name, its oid where unknown, `-` for 0."""
    return lambda raw: "-" if _take("I", raw)[0] == 0 else names.get(_take("I", raw)[0], str(_take("I", raw)[0]))


def int16(raw: bytes) -> str:
    """A 128-bit integer."""
    if len(raw) < 16:
        raise Broken("16 bytes are needed")
    return str(int.from_bytes(raw[:16], "little", signed=True))


def escaped(raw: bytes) -> str:
    """Bytes in the escape form: backslash doubled, what isn't printable in octal."""
    return "".join("\\\\" if b == 92 else chr(b) if 32 <= b < 127 else f"\\{b:03o}" for b in raw)


def signed_clock(raw: bytes) -> str:
    """A signed time that may pass 24 hours."""
    us = _take("q", raw)[0]
    return ("-" if us < 0 else "") + _clock(abs(us))


_i2, _i4, _i8, _u4 = _number("h"), _number("i"), _number("q"), _number("I")
_tz = lambda raw: timestamp(raw, "+00")

#: By type name: (length, alignment, decoder). Length -1: variable, -2: C string.
TYPES: dict[str, tuple[int, int, Decoder]] = {
    "bool": (1, 1, bool_), "int2": (2, 2, _i2), "int4": (4, 4, _i4), "int8": (8, 8, _i8), "tinyint": (1, 1, _number("b")), "oid": (4, 4, _u4), "xid": (4, 4, _u4), "cid": (4, 4, _u4), "xid8": (8, 8, _number("Q")),
    "tid": (6, 2, tid), "float4": (4, 4, _float("f")), "float8": (8, 8, _float("d")), "numeric": (-1, 4, numeric), "money": (8, 8, money), "text": (-1, 4, text), "varchar": (-1, 4, text), "bpchar": (-1, 4, text),
    "name": (64, 1, name_), "char": (1, 1, char_), "cstring": (-2, 1, text), "bytea": (-1, 4, bytea), "date": (4, 4, date_), "time": (8, 8, time_), "timetz": (12, 8, timetz), "timestamp": (8, 8, timestamp), "timestamptz": (8, 8, _tz),
    "interval": (16, 8, interval), "uuid": (16, 1, uuid), "json": (-1, 4, text), "xml": (-1, 4, text), "jsonb": (-1, 4, jsonb), "inet": (-1, 4, inet), "cidr": (-1, 4, lambda r: inet(r, True)), "macaddr": (6, 4, _mac), "macaddr8": (8, 4, _mac),
    "bit": (-1, 4, bits), "varbit": (-1, 4, bits), "int2vector": (-1, 4, oidvector("h")), "oidvector": (-1, 4, oidvector("I")), "pg_lsn": (8, 8, pg_lsn), "txid_snapshot": (-1, 8, txid_snapshot), "pg_node_tree": (-1, 4, text),
    "int16": (16, 8, int16), "blob": (-1, 4, escaped), "binary": (-1, 4, lambda r: "0x" + r.hex().upper()), "clob": (-1, 4, text), "mysqltime": (8, 8, signed_clock),
    "point": (16, 8, point), "lseg": (32, 8, lambda r: f"[{_points(r, 0, 2)}]"), "box": (32, 8, lambda r: _points(r, 0, 2)), "path": (-1, 8, path), "polygon": (-1, 8, polygon), "line": (24, 8, lambda r: "{" + ",".join(_coord(r, 8 * i) for i in range(3)) + "}"),
    "circle": (24, 8, lambda r: f"<{point(r)},{_coord(r, 16)}>"), "tsvector": (-1, 4, tsvector), "tsquery": (-1, 4, tsquery), "aclitem": (12, 4, aclitem()), "regclass": (4, 4, registered({})), "regtype": (4, 4, registered({})), "regproc": (4, 4, registered({})),
}
for _name, _of in (("int4range", "int4"), ("int8range", "int8"), ("numrange", "numeric"), ("tsrange", "timestamp"), ("tstzrange", "timestamptz"), ("daterange", "date")):
    TYPES[_name] = (-1, 8 if TYPES[_of][1] == 8 else 4, range_(*TYPES[_of]))
    TYPES[_name.replace("range", "multirange")] = (-1, 8 if TYPES[_of][1] == 8 else 4, multirange(*TYPES[_of]))
for _name in [*TYPES]:
    TYPES["_" + _name] = (-1, 8 if TYPES[_name][1] == 8 else 4, array(*TYPES[_name], ";" if _name == "box" else ","))

# Oids of built-in types.
OIDS = {
    16: "bool", 17: "bytea", 18: "char", 19: "name", 20: "int8", 21: "int2", 22: "int2vector", 23: "int4", 24: "regproc", 25: "text", 26: "oid", 27: "tid", 28: "xid", 29: "cid", 30: "oidvector", 114: "json", 142: "xml", 194: "pg_node_tree",
    600: "point", 601: "lseg", 602: "path", 603: "box", 604: "polygon", 628: "line", 650: "cidr", 700: "float4", 701: "float8", 705: "text", 718: "circle", 774: "macaddr8", 790: "money", 829: "macaddr", 869: "inet", 1033: "aclitem", 1042: "bpchar",
    1043: "varchar", 1082: "date", 1083: "time", 1114: "timestamp", 1184: "timestamptz", 1186: "interval", 1266: "timetz", 1560: "bit", 1562: "varbit", 1700: "numeric", 2205: "regclass", 2206: "regtype", 2950: "uuid", 2970: "txid_snapshot",
    3220: "pg_lsn", 3614: "tsvector", 3615: "tsquery", 3802: "jsonb", 3904: "int4range", 3906: "numrange", 3908: "tsrange", 3910: "tstzrange", 3912: "daterange", 3926: "int8range", 4451: "int4multirange", 4532: "nummultirange", 4533: "tsmultirange",
    4534: "tstzmultirange", 4535: "datemultirange", 4536: "int8multirange", 1000: "_bool", 1001: "_bytea", 1005: "_int2", 1007: "_int4", 1009: "_text", 1014: "_bpchar", 1015: "_varchar", 1016: "_int8", 1021: "_float4", 1022: "_float8", 1115: "_timestamp",
    1182: "_date", 1183: "_time", 1185: "_timestamptz", 1187: "_interval", 1231: "_numeric", 2951: "_uuid", 4659: "int16", 8013: "blob", 8014: "clob", 3383: "binary", 3384: "binary", 7944: "date", 7950: "mysqltime", 7952: "timestamp", 7024: "jsonb", 199: "_json", 3807: "_jsonb", 1028: "_oid", 1041: "_inet",
}


@lru_cache(maxsize=4096)
def user_type(spec: str) -> tuple[int, int, Decoder]:
    """Length, alignment and decoder of a user's type from JSON: {"enum": {oid: label}}, {"row": [type, ...]} or
    {"array": type}, where a type is a name or such a description again."""
    made = json.loads(spec)
    part = lambda t: TYPES.get(t, (-1, 4, text)) if isinstance(t, str) else user_type(json.dumps(t))
    if "enum" in made:
        return 4, 4, enum({int(k): v for k, v in made["enum"].items()})
    if "array" in made:
        of = part(made["array"])
        return -1, 8 if of[1] == 8 else 4, array(*of)
    return -1, 8, composite([part(t) for t in made["row"]])


def decoder(kind: int | str) -> Decoder:
    """The decoder of a type by oid, name or description; text or hexadecimal for unknown ones."""
    if isinstance(kind, str) and kind.startswith("{"):
        return user_type(kind)[2]
    name = OIDS.get(kind, "") if isinstance(kind, int) else kind
    return TYPES[name][2] if name in TYPES else text


def decode(kind: int | str, raw: bytes | None) -> str | None:
    """Canonical text of a value; NULL stays NULL, broken bytes give hexadecimal text instead of an error."""
    if raw is None:
        return None
    try:
        return decoder(kind)(raw)
    except (Broken, IndexError, ValueError, OverflowError):
        return bytea(raw)
