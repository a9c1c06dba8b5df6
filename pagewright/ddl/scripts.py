"""Headers, paths, guards and scripts around exported files."""

from __future__ import annotations

import glob
import os
import re
import shlex
from collections.abc import Iterable, Sequence

from pagewright.ddl.nodetree import quote_literal


def session_header(encoding: str = "UTF8", timezone: str | None = None) -> str:
    """Settings an import needs first: encoding, literal rules, time zone."""
    lines = [f"SET client_encoding = {quote_literal(encoding)};", "SET standard_conforming_strings = on;"]
    if timezone:
        lines.append(f"SET timezone = {quote_literal(timezone)};")
    return "\n".join(lines) + "\n"


def file_component(name: str, limit: int = 200) -> str:
    """A name that is safe as part of a path."""
    safe = re.sub(r'[\x00-\x1f/\\:*?"<>|]', "_", name).strip(". ") or "_"
    return safe[:limit]


def output_path(folder: str, schema: str | None, table: str, suffix: str) -> str:
    return os.path.join(folder, f"{file_component(schema or 'public')}.{file_component(table)}.{suffix.lstrip('.')}")


def guard_output(output: str, sources: Iterable[str]) -> None:
    """Refuse an output that is one of the sources or their segments, also through links."""
    real = os.path.realpath(output)
    for source in sources:
        for path in (source, *glob.glob(glob.escape(source) + ".*")):
            if os.path.realpath(path) == real or (os.path.exists(path) and os.path.exists(output) and os.path.samefile(path, output)):
                raise ValueError(f"{output} would overwrite the source {path}")


def import_script(files: Sequence[tuple[str, str]], database: str = "", timezone: str | None = None, form: str = "") -> str:
    """A shell script that loads files (path, table): structure first, then data, then what follows; in order of names.

    The rank comes from a file's ending: .ddl.sql, then .sql, .csv and .txt, then .post.sql. `form` (.csv or .txt) tells what
    files are whose endings don't.
    """

    def rank(path: str) -> tuple[int, str]:
        return (0 if path.endswith(".ddl.sql") else 2 if path.endswith(".post.sql") else 1, path)

    lines = ["#!/bin/sh", "set -e", f'DB="${{1:-{database}}}"']
    if timezone:
        lines.append(f"export PGTZ={shlex.quote(timezone)}")
    for path, table in sorted(files, key=lambda f: rank(f[0])):
        if path.endswith(".sql") or not (form or path.endswith((".csv", ".txt"))):
            lines.append(f'psql -v ON_ERROR_STOP=1 -d "$DB" -f {shlex.quote(path)}')
        else:
            form = "format csv, null '\\N'" if (form or path).endswith(".csv") else "format text"
            command = f"\\copy {table} from '{path}' with ({form})"
            lines.append(f'psql -v ON_ERROR_STOP=1 -d "$DB" -c {shlex.quote(command)}')
    return "\n".join(lines) + "\n"


def split_names(text: str) -> list[str]:
    """Names separated by commas; quoted parts keep commas and capitals, bare ones become small."""
    out = []
    for m in re.finditer(r'\s*((?:"(?:[^"]|"")*"|[^,"])+)', text):
        parts = [p[1:-1].replace('""', '"') if p.startswith('"') else p.strip().lower() for p in re.findall(r'"(?:[^"]|"")*"|[^".]+', m.group(1).strip())]
        name = ".".join(p for p in parts if p)
        if name:
            out.append(name)
    return out


def delimiter(text: str) -> str:
    """A delimiter as written on a command line: escapes for tab and the like, one byte."""
    char = {"\\t": "\t", "tab": "\t", "\\v": "\v", "\\f": "\f"}.get(text, text)
    if len(char.encode()) != 1 or char in '\r\n"\\' or char.isalnum() or char == ".":
        raise ValueError(f"{text!r} can't delimit fields")
    return char


def mask_secret(text: str) -> str:
    """A secret for a log: its ends, or nothing of a short one."""
    return "*" * len(text) if len(text) < 8 else f"{text[:2]}{'*' * (len(text) - 4)}{text[-2:]}"


def compatibility(config: str, type_names: Iterable[str] = ()) -> str:
    """The mode of a database: `oracle` by its configuration, `mysql` by its types, else `pg`; the last setting counts."""
    found = re.findall(r"^\s*database_mode\s*=\s*'?(\w+)'?", config, re.MULTILINE | re.IGNORECASE)
    if found and found[-1].lower() == "oracle":
        return "oracle"
    return "mysql" if {"mysql_time", "mysql_timestamp", "tinyint"} & {n.lower() for n in type_names} else "pg"


def timezone_hint(columns: Iterable[tuple[str, str]], timezone: str | None) -> str:
    """A warning where columns (name, type) need a time zone that isn't known."""
    need = sorted(n for n, t in columns if t in ("timestamptz", "mysqltimestamp"))
    return f"no time zone is known for: {', '.join(need)}" if need and not timezone else ""


def last_segment_full(size: int, page_size: int = 8192, segment_pages: int = 131_072) -> bool:
    """Whether the last segment is exactly full, a weak sign that another one is missing."""
    return size == page_size * segment_pages


def progress_line(done: int, total: int, rows: int, seconds: float) -> str:
    """Pages done, rows so far and what is left, from running totals."""
    share = done / total if total else 1.0
    left = seconds * (1 - share) / share if share else 0.0
    return f"{share:.0%} of {total} pages, {rows} rows, {seconds:.0f} s, {left:.0f} s left"
