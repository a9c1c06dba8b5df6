"""Array and record literals taken apart, and single-byte characters written so that every byte survives."""

from __future__ import annotations


class Malformed(ValueError):
    """The text is no literal of the kind."""


def parse_array(text: str, separator: str = ",") -> list:
    """Nested lists of texts (None for NULL) from an array literal; bounds in front are skipped."""
    if text.startswith("["):
        text = text[text.index("=") + 1 :]
    at = 0

    def items() -> list:
        nonlocal at
        if at >= len(text) or text[at] != "{":
            raise Malformed(text)
        at += 1
        out: list = []
        if at < len(text) and text[at] == "}":
            at += 1
            return out
        while True:
            if at >= len(text):
                raise Malformed(text)
            if text[at] == "{":
                out.append(items())
            elif text[at] == '"':
                at += 1
                chars = []
                while at < len(text) and text[at] != '"':
                    if text[at] == "\\":
                        at += 1
                    chars.append(text[at : at + 1])
                    at += 1
                at += 1
                out.append("".join(chars))
            else:
                start = at
                while at < len(text) and text[at] not in (separator, "}"):
                    at += 2 if text[at] == "\\" else 1
                word = text[start:at]
                out.append(None if word.upper() == "NULL" else word.replace("\\", ""))
            if at >= len(text):
                raise Malformed(text)
            at += 1
            if text[at - 1] == "}":
                return out
            if text[at - 1] != separator:
                raise Malformed(text)

    found = items()
    if at != len(text):
        raise Malformed(text)
    return found


def parse_record(text: str) -> list[str | None]:
    """Fields of a record literal; nothing between commas is NULL."""
    if len(text) < 2 or text[0] != "(" or text[-1] != ")":
        raise Malformed(text)
    out: list[str | None] = []
    at, end = 1, len(text) - 1
    while True:
        chars, quoted = [], False
        while at < end and text[at] != ",":
            if text[at] == '"':
                quoted = True
                at += 1
                while at < end:
                    if text[at] == '"' and at + 1 < end and text[at + 1] == '"':
                        chars.append('"')
                        at += 2
                    elif text[at] == '"':
                        break
                    else:
                        if text[at] == "\\":
                            at += 1
                        chars.append(text[at])
                        at += 1
                if at >= end:
                    raise Malformed(text)
                at += 1
            else:
                if text[at] == "\\":
                    at += 1
                chars.append(text[at])
                at += 1
        out.append("".join(chars) if chars or quoted else None)
        if at >= end:
            return out
        at += 1


def char_literal(byte: int | None) -> str:
    """A "char" value as an expression that keeps the byte: quoted ASCII, an octal escape for others, empty for zero."""
    if byte is None:
        return 'NULL::"char"'
    if byte == 0:
        return "''::\"char\""
    if byte < 128:
        shown = {"'": "''", "\\": "\\\\"}.get(chr(byte), chr(byte))
        return f"E'{shown}'::\"char\"" if byte == 92 else f"'{shown}'::\"char\""
    return f"E'\\\\{byte:03o}'::\"char\""


def at_risk(values: list) -> bool:
    """Whether a nested list holds bytes that a text literal would lose: zero or beyond ASCII."""
    return any(at_risk(v) if isinstance(v, list) else v is not None and (v == 0 or v > 127) for v in values)


def char_array(values: list) -> str:
    """A nested list of bytes as ARRAY[...]; the empty one as a cast literal."""

    def inner(level: list) -> str:
        return "[" + ", ".join(inner(v) if isinstance(v, list) else char_literal(v) for v in level) + "]"

    return "ARRAY" + inner(values) if values else "'{}'::\"char\"[]"


def char_record(fields: list[str], type_name: str) -> str:
    """A record of field expressions as ROW(...) of its type."""
    return f"ROW({', '.join(fields)})::{type_name}"
