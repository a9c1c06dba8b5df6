"""Serialized expression trees: a parser and a deparser to SQL."""

from __future__ import annotations

import re
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pagewright.functions.decode import OIDS, decode

# Operators by oid; more come from the operator catalog as a parameter.
OPERATORS: Mapping[int, str] = {
    91: "=", 85: "<>", 94: "=", 95: "<", 519: "<>", 520: ">", 522: "<=", 524: ">=", 96: "=", 97: "<", 518: "<>", 521: ">", 523: "<=", 525: ">=", 410: "=", 411: "<>", 412: "<", 413: ">", 414: "<=", 415: ">=", 98: "=", 531: "<>", 664: "<", 665: "<=", 666: ">", 667: ">=",
    551: "+", 555: "-", 514: "*", 528: "/", 530: "%", 684: "+", 685: "-", 686: "*", 687: "/", 654: "||", 641: "~", 642: "!~", 1209: "~~", 1210: "!~~", 1625: "~~*", 1752: "=", 1753: "<>", 1754: "<", 1755: "<=", 1756: ">", 1757: ">=", 1758: "+", 1759: "-", 1760: "*", 1761: "/",
    1093: "=", 1094: "<>", 1095: "<", 1096: "<=", 1097: ">", 1098: ">=", 2060: "=", 2061: "<>", 2062: "<", 2063: "<=", 2064: ">", 2065: ">=", 1320: "=", 1321: "<>", 1322: "<", 1323: "<=", 1324: ">", 1325: ">=", 670: "=", 672: "<", 674: ">", 1054: "=", 1057: "<>",
}
# Functions by oid, the ones that default and check expressions use most.
FUNCTIONS: Mapping[int, str] = {1574: "nextval", 1299: "now", 870: "lower", 871: "upper", 1317: "length", 401: "text", 669: "varchar", 668: "bpchar", 1703: "numeric", 481: "int8", 480: "int4", 316: "float8", 2647: "transaction_timestamp", 2649: "clock_timestamp", 3432: "gen_random_uuid"}
_BARE = {20, 21, 23, 26, 700, 701, 1700}
_TYPE_NAMES = {"bool": "boolean", "int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "varchar": "character varying", "bpchar": "character", "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone", "time": "time without time zone", "timetz": "time with time zone", "varbit": "bit varying"}


@dataclass
class Node:
    kind: str
    attrs: dict[str, object] = field(default_factory=dict)

    def num(self, name: str, default: int = 0) -> int:
        try:
            return int(self.attrs.get(name, default))  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return default

    def args(self, name: str = "args") -> list:
        found = self.attrs.get(name)
        return found if isinstance(found, list) else []


_TOKEN = re.compile(r"\s*(\{|\}|\(|\)|\[|\]|:[A-Za-z_]\w*|<>|\"(?:[^\"\\]|\\.)*\"|(?:[^\s{}()\[\]\\]|\\.)+)", re.DOTALL)


def parse(text: str) -> object:
    """The tree of a serialized expression: Node, list, text or None; None for text that is no tree. Never loops on
    broken text: each step takes a token."""
    tokens = [m.group(1) for m in _TOKEN.finditer(text or "")]
    at = 0

    def value():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the tree ends early")
        token = tokens[at]
        at += 1
        if token == "{":
            node = Node(tokens[at])
            at += 1
            while tokens[at] != "}":
                name = tokens[at]
                at += 1
                if not name.startswith(":"):
                    raise ValueError(f"{name} is no attribute")
                parts = []
                while tokens[at] != "}" and not tokens[at].startswith(":"):
                    parts.append(value())
                node.attrs[name[1:]] = parts[0] if len(parts) == 1 else parts
            at += 1
            return node
        if token in "([":
            end, items = (")", "]")[token == "["], []
            while tokens[at] != end:
                items.append(value())
            at += 1
            return items
        if token in "})]":
            raise ValueError("a bracket closes nothing")
        if token == "<>":
            return None
        return re.sub(r"\\(.)", r"\1", token)

    try:
        return value()
    except (ValueError, IndexError, RecursionError):
        return None


# Words that SQL keeps for itself.
RESERVED = frozenset(
    """all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column concurrently
    constraint create cross current_catalog current_date current_role current_schema current_time current_timestamp current_user default
    deferrable desc distinct do else end except false fetch for foreign freeze from full grant group having ilike in initially inner
    intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null offset on only or
    order outer overlaps placing primary references returning right select session_user similar some symmetric system_user table
    tablesample then to trailing true union unique user using variadic verbose when where window with""".split()
)


def quote_ident(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_$]*", name) and name not in RESERVED else '"' + name.replace('"', '""') + '"'


def quote_literal(text: str) -> str:
    return ("E'" + text.replace("\\", "\\\\").replace("'", "''") + "'") if "\\" in text else "'" + text.replace("'", "''") + "'"


def type_text(oid: int, typmod: int = -1, names: Mapping[int, str] | None = None) -> str:
    """SQL text of a type with its modifier; a negative numeric scale stays negative."""
    name = OIDS.get(oid) or (names or {}).get(oid, f"oid {oid}")
    array = name.startswith("_")
    base = name.removeprefix("_")
    shown = _TYPE_NAMES.get(base, base if oid in OIDS else quote_ident(base))
    if typmod >= 0:
        if base in ("varchar", "bpchar"):
            shown += f"({typmod - 4})"
        elif base == "numeric":
            precision, scale = typmod - 4 >> 16 & 0xFFFF, (typmod - 4 & 0x7FF ^ 0x400) - 0x400
            shown += f"({precision},{scale})"
        elif base in ("bit", "varbit"):
            shown += f"({typmod})"
        elif base in ("time", "timetz", "timestamp", "timestamptz"):
            head, _, tail = shown.partition(" ")
            shown = f"{head}({typmod}) {tail}".strip()
    return shown + ("[]" if array else "")


def _datum(node: Node) -> bytes | None:
    raw = node.attrs.get("constvalue")
    if not isinstance(raw, list) or len(raw) < 2 or not isinstance(raw[1], list):
        return None
    try:
        return bytes(int(x) & 0xFF for x in raw[1])
    except (TypeError, ValueError):
        return None


def constant(node: Node, names: Mapping[int, str] | None = None) -> str:
    """A constant as literal with its type where the bare text would mean another."""
    oid = node.num("consttype")
    if node.attrs.get("constisnull") == "true":
        return f"NULL::{type_text(oid, node.num('consttypmod', -1), names)}"
    raw = _datum(node)
    if raw is None:
        return ""
    length = node.num("constlen", -1)
    if length == -1:
        if len(raw) >= 4:
            word = struct.unpack_from("<I", raw)[0]
            raw = raw[1 : raw[0] >> 1] if raw[0] & 1 else raw[4 : word >> 2]
    elif length > 0:
        raw = raw[:length]
    text = decode(oid, raw) or ""
    if oid == 16:
        return "true" if text == "t" else "false"
    if oid in _BARE and re.fullmatch(r"-?[\d.]+(?:e[+-]\d+)?", text):
        return f"({text})" if text.startswith("-") else text
    return f"{quote_literal(text)}::{type_text(oid, -1, names)}"


class Deparser:
    """Expression trees as SQL. Names of columns, functions, operators and types are parameters; what the deparser doesn't
    know makes the whole text empty, so a caller can fall back to a comment."""

    def __init__(self, columns: Sequence[str] = (), operators: Mapping[int, str] | None = None, functions: Mapping[int, str] | None = None, types: Mapping[int, str] | None = None, sequences: Mapping[int, str] | None = None) -> None:
        self.columns = columns
        self.operators = {**OPERATORS, **(operators or {})}
        self.functions = {**FUNCTIONS, **(functions or {})}
        self.types = types or {}
        self.sequences = sequences or {}

    def text(self, tree: str) -> str:
        try:
            return self.expr(parse(tree))
        except (_Unknown, RecursionError):
            return ""

    def list(self, tree: str) -> list[str]:
        """The texts of a list of expressions, as index expressions are kept; empty if one is unknown."""
        node = parse(tree)
        try:
            return [self.expr(n) for n in (node if isinstance(node, list) else [node])]
        except (_Unknown, RecursionError):
            return []

    def expr(self, node: object) -> str:
        if isinstance(node, list) and len(node) == 1:
            return self.expr(node[0])
        if not isinstance(node, Node):
            raise _Unknown
        made = getattr(self, "_" + node.kind.lower(), None)
        if made is None:
            raise _Unknown
        text = made(node)
        if not text:
            raise _Unknown
        return text

    def inner(self, node: object) -> str:
        """An operand: in brackets if it has an operator of its own."""
        text = self.expr(node)
        return f"({text})" if isinstance(node, Node) and node.kind in ("OPEXPR", "BOOLEXPR", "SCALARARRAYOPEXPR", "NULLTEST", "DISTINCTEXPR") else text

    def _var(self, n: Node) -> str:
        at = n.num("varattno")
        return quote_ident(self.columns[at - 1]) if 0 < at <= len(self.columns) else ""

    def _const(self, n: Node) -> str:
        return constant(n, self.types)

    def _coercetodomainvalue(self, n: Node) -> str:
        return "VALUE"

    def _opexpr(self, n: Node) -> str:
        sign, args = self.operators.get(n.num("opno")), n.args()
        if sign is None or not 0 < len(args) < 3:
            return ""
        return f"{sign} {self.inner(args[0])}" if len(args) == 1 else f"{self.inner(args[0])} {sign} {self.inner(args[1])}"

    def _distinctexpr(self, n: Node) -> str:
        a, b = n.args()
        return f"{self.inner(a)} IS DISTINCT FROM {self.inner(b)}"

    def _scalararrayopexpr(self, n: Node) -> str:
        sign, args = self.operators.get(n.num("opno")), n.args()
        if sign is None or len(args) != 2:
            return ""
        return f"{self.inner(args[0])} {sign} {'ANY' if n.attrs.get('useOr') == 'true' else 'ALL'} ({self.expr(args[1])})"

    def _arrayexpr(self, n: Node) -> str:
        return f"ARRAY[{', '.join(self.expr(a) for a in n.args('elements'))}]"

    def _boolexpr(self, n: Node) -> str:
        op, args = str(n.attrs.get("boolop", "")), n.args()
        if op == "not":
            return f"NOT {self.inner(args[0])}"
        return f" {op.upper()} ".join(self.inner(a) for a in args) if op in ("and", "or") else ""

    def _nulltest(self, n: Node) -> str:
        return f"{self.inner(n.attrs.get('arg'))} IS {'NOT ' if n.num('nulltesttype') == 1 else ''}NULL"

    def _relabeltype(self, n: Node) -> str:
        text = self.inner(n.attrs.get("arg"))
        return text if n.num("relabelformat") == 2 else f"{text}::{type_text(n.num('resulttype'), n.num('resulttypmod', -1), self.types)}"

    def _coerceviaio(self, n: Node) -> str:
        text = self.inner(n.attrs.get("arg"))
        return text if n.num("coerceformat") == 2 else f"{text}::{type_text(n.num('resulttype'), -1, self.types)}"

    def _funcexpr(self, n: Node) -> str:
        args, form = n.args(), n.num("funcformat")
        if form in (1, 2) and args:  # explicit and implicit casts
            text = self.inner(args[0])
            mod = -1
            if len(args) > 1 and isinstance(args[1], Node) and args[1].kind == "CONST":
                raw = _datum(args[1])
                mod = struct.unpack_from("<i", raw)[0] if raw and len(raw) >= 4 else -1
            return text if form == 2 and mod < 0 else f"{text}::{type_text(n.num('funcresulttype'), mod, self.types)}"
        name = self.functions.get(n.num("funcid"))
        if name is None:
            return ""
        if name == "nextval" and args and isinstance(args[0], Node) and args[0].kind == "CONST":
            raw = _datum(args[0])
            oid = struct.unpack_from("<I", raw)[0] if raw and len(raw) >= 4 else 0
            return f"nextval({quote_literal(self.sequences[oid])}::regclass)" if oid in self.sequences else ""
        return f"{name}({', '.join(self.expr(a) for a in args)})"

    def _sqlvaluefunction(self, n: Node) -> str:
        return {0: "CURRENT_DATE", 3: "CURRENT_TIMESTAMP", 7: "LOCALTIMESTAMP", 9: "CURRENT_ROLE", 10: "CURRENT_USER", 12: "SESSION_USER"}.get(n.num("op"), "")


class _Unknown(Exception):
    pass


def partition_bound(tree: str, types: Mapping[int, str] | None = None) -> str:
    """FOR VALUES ... of a partition, DEFAULT, or empty text where the tree is unknown."""
    node = parse(tree)
    if not isinstance(node, Node) or node.kind != "PARTITIONBOUNDSPEC":
        return ""
    if node.attrs.get("is_default") == "true":
        return "DEFAULT"
    show = lambda n: re.sub(r"::[\w ]+$", "", constant(n, types)) if isinstance(n, Node) and n.kind == "CONST" else ""
    strategy = str(node.attrs.get("strategy", ""))
    if strategy in ("h", "104"):
        return f"FOR VALUES WITH (modulus {node.num('modulus')}, remainder {node.num('remainder')})"
    if strategy in ("l", "108"):
        values = [show(n) for n in node.args("listdatums")]
        return f"FOR VALUES IN ({', '.join(values)})" if values and all(values) else ""

    def bound(items: list) -> str:
        out = []
        for n in items:
            kind = n.num("kind") if isinstance(n, Node) else 0
            out.append("MINVALUE" if kind == -1 else "MAXVALUE" if kind == 1 else show(n.attrs.get("value")) if isinstance(n, Node) and n.kind == "PARTITIONRANGEDATUM" else show(n))
        return ", ".join(out) if out and all(out) else ""

    low, high = bound(node.args("lowerdatums")), bound(node.args("upperdatums"))
    return f"FOR VALUES FROM ({low}) TO ({high})" if low and high else ""
