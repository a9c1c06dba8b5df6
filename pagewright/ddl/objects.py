"""CREATE statements of tables, types, indexes, sequences, roles, functions, triggers, keys and views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pagewright.ddl.nodetree import quote_ident, quote_literal


def qualified(schema: str | None, name: str) -> str:
    return f"{quote_ident(schema)}.{quote_ident(name)}" if schema else quote_ident(name)


def guarded(statement: str, errors: Sequence[str] = ("duplicate_object", "duplicate_table")) -> str:
    """A statement that may run twice: its duplicate errors are caught."""
    tag = "$pw$"
    while tag in statement:
        tag = tag[:-1] + "x$"
    return f"DO {tag} BEGIN\n  {statement.rstrip(';')};\nEXCEPTION WHEN {' OR '.join(errors)} THEN NULL;\nEND {tag};"


def dollar_quote(body: str) -> str:
    """A body between dollar quotes that don't occur in it."""
    n, tag = 0, "$$"
    while tag in body or (body.endswith("$") and tag == "$$"):
        n += 1
        tag = f"$body{n}$"
    return f"{tag}{body}{tag}"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    default: str = ""
    identity: str = ""
    generated: str = ""
    collation: str = ""
    dropped: bool = False
    comment: str = ""


@dataclass
class Table:
    name: str
    schema: str | None = None
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    partition_by: str = ""
    partition_of: str = ""
    bound: str = ""
    unlogged: bool = False
    checks: dict[str, str] = field(default_factory=dict)
    comment: str = ""


def column_sql(c: Column) -> str:
    parts = [quote_ident(c.name), c.type]
    if c.collation:
        parts.append(f"COLLATE {quote_ident(c.collation)}")
    if c.generated:
        parts.append(f"GENERATED ALWAYS AS ({c.generated}) STORED")
    elif c.identity in ("a", "d"):
        parts.append(f"GENERATED {'ALWAYS' if c.identity == 'a' else 'BY DEFAULT'} AS IDENTITY")
    elif c.default:
        parts.append(f"DEFAULT {c.default}")
    if c.not_null:
        parts.append("NOT NULL")
    return " ".join(parts)


def covers(key: Iterable[str], partition_key: Iterable[str]) -> bool:
    """Whether a primary key holds all columns of the partition key, as the server demands."""
    return set(partition_key) <= set(key)


def table_sql(t: Table, partition_key: Sequence[str] = ()) -> list[str]:
    """CREATE TABLE and its comments; checks that can't be written are comments in the text."""
    name = qualified(t.schema, t.name)
    kind = "UNLOGGED TABLE" if t.unlogged else "TABLE"
    if t.partition_of:
        out = [f"CREATE {kind} {name} PARTITION OF {t.partition_of} {t.bound}" + (f" PARTITION BY {t.partition_by}" if t.partition_by else "") + ";"]
    else:
        lines = [column_sql(c) for c in t.columns if not c.dropped]
        if t.primary_key and (not partition_key or covers(t.primary_key, partition_key)):
            lines.append(f"PRIMARY KEY ({', '.join(map(quote_ident, t.primary_key))})")
        notes = []
        for check, expr in t.checks.items():
            if expr:
                lines.append(f"CONSTRAINT {quote_ident(check)} CHECK ({expr})")
            else:
                notes.append(f"-- CHECK {check} can't be written as SQL")
        body = ",\n    ".join(lines)
        out = [*notes, f"CREATE {kind} {name} (\n    {body}\n)" + (f" PARTITION BY {t.partition_by}" if t.partition_by else "") + ";"]
    if t.comment:
        out.append(f"COMMENT ON TABLE {name} IS {quote_literal(t.comment)};")
    out += [f"COMMENT ON COLUMN {name}.{quote_ident(c.name)} IS {quote_literal(c.comment)};" for c in t.columns if c.comment and not c.dropped]
    return out


def partition_clause(strategy: str, keys: Sequence[str]) -> str:
    """PARTITION BY clause: RANGE, LIST or HASH over columns or bracketed expressions."""
    word = {"r": "RANGE", "l": "LIST", "h": "HASH"}[strategy]
    return f"{word} ({', '.join(keys)})"


def index_sql(name: str, table: str, keys: Sequence[str], unique: bool = False, method: str = "btree", include: Sequence[str] = (), where: str = "") -> str:
    text = f"CREATE {'UNIQUE ' if unique else ''}INDEX {quote_ident(name)} ON {table} USING {method} ({', '.join(keys)})"
    if include:
        text += f" INCLUDE ({', '.join(map(quote_ident, include))})"
    return text + (f" WHERE {where}" if where else "") + ";"


def exclude_sql(name: str, table: str, elements: Sequence[tuple[str, str]], method: str = "gist") -> str:
    return f"ALTER TABLE {table} ADD CONSTRAINT {quote_ident(name)} EXCLUDE USING {method} ({', '.join(f'{k} WITH {op}' for k, op in elements)});"


def foreign_key_sql(name: str, table: str, columns: Sequence[str], target: str, target_columns: Sequence[str], on_delete: str = "a", on_update: str = "a", valid: bool = True, deferrable: bool = False, deferred: bool = False) -> str:
    actions = {"r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
    text = f"ALTER TABLE {table} ADD CONSTRAINT {quote_ident(name)} FOREIGN KEY ({', '.join(map(quote_ident, columns))}) REFERENCES {target} ({', '.join(map(quote_ident, target_columns))})"
    if on_update in actions:
        text += f" ON UPDATE {actions[on_update]}"
    if on_delete in actions:
        text += f" ON DELETE {actions[on_delete]}"
    if deferrable:
        text += " DEFERRABLE" + (" INITIALLY DEFERRED" if deferred else "")
    return text + ("" if valid else " NOT VALID") + ";"


def enum_sql(name: str, labels: Sequence[str]) -> str:
    return f"CREATE TYPE {name} AS ENUM ({', '.join(map(quote_literal, labels))});"


def composite_sql(name: str, fields: Sequence[tuple[str, str]]) -> str:
    return f"CREATE TYPE {name} AS ({', '.join(f'{quote_ident(n)} {t}' for n, t in fields)});"


def domain_sql(name: str, base: str, not_null: bool = False, default: str = "", checks: Mapping[str, str] | None = None) -> str:
    text = f"CREATE DOMAIN {name} AS {base}" + (f" DEFAULT {default}" if default else "") + (" NOT NULL" if not_null else "")
    for check, expr in (checks or {}).items():
        text += f" CONSTRAINT {quote_ident(check)} CHECK ({expr})"
    return text + ";"


def type_order(needs: Mapping[str, Iterable[str]]) -> list[str]:
    """Types in an order in which each comes after those it needs; a circle is entered once."""
    out: list[str] = []
    state: dict[str, int] = {}
    for start in sorted(needs):
        stack = [(start, iter(sorted(needs.get(start, ()))))]
        if state.get(start):
            continue
        state[start] = 1
        while stack:
            name, rest = stack[-1]
            following = next((n for n in rest if n in needs and not state.get(n)), None)
            if following is None:
                out.append(name)
                stack.pop()
            else:
                state[following] = 1
                stack.append((following, iter(sorted(needs[following]))))
    return out


def sequence_sql(name: str, start: int = 1, increment: int = 1, minimum: int = 1, maximum: int = 2**63 - 1, cache: int = 1, cycle: bool = False, data_type: str = "bigint", last: int | None = None, called: bool = True, owned_by: str = "") -> list[str]:
    """CREATE SEQUENCE, its owner, and setval to where it stands."""
    out = [f"CREATE SEQUENCE {name} AS {data_type} INCREMENT BY {increment} MINVALUE {minimum} MAXVALUE {maximum} START WITH {start} CACHE {cache}{' CYCLE' if cycle else ''};"]
    if owned_by:
        out.append(f"ALTER SEQUENCE {name} OWNED BY {owned_by};")
    if last is not None:
        out.append(f"SELECT setval({quote_literal(name)}, {last}, {'true' if called else 'false'});")
    return out


@dataclass
class Role:
    name: str
    oid: int = 16384
    superuser: bool = False
    inherit: bool = True
    createrole: bool = False
    createdb: bool = False
    login: bool = False
    replication: bool = False
    bypassrls: bool = False
    limit: int = -1
    password: str = ""
    valid_until: str = ""


def is_builtin_role(oid: int, name: str) -> bool:
    return oid < 16384 or name.startswith("pg_")


def role_sql(roles: Sequence[Role], members: Sequence[tuple[str, str, bool]] = (), with_password: bool = True) -> list[str]:
    """CREATE ROLE of all roles but built-in ones, then grants (role, member, with admin option), each once, in order of names."""
    out = []
    own = {r.name for r in roles if not is_builtin_role(r.oid, r.name)}
    for r in sorted(roles, key=lambda r: r.name):
        if r.name not in own:
            continue
        flags = [("" if on else "NO") + word for on, word in ((r.superuser, "SUPERUSER"), (r.inherit, "INHERIT"), (r.createrole, "CREATEROLE"), (r.createdb, "CREATEDB"), (r.login, "LOGIN"), (r.replication, "REPLICATION"), (r.bypassrls, "BYPASSRLS"))]
        text = f"CREATE ROLE {quote_ident(r.name)} WITH {' '.join(flags)}"
        if r.limit >= 0:
            text += f" CONNECTION LIMIT {r.limit}"
        if r.password and with_password:
            text += f" PASSWORD {quote_literal(r.password)}"
        if r.valid_until:
            text += f" VALID UNTIL {quote_literal(r.valid_until)}"
        out.append(guarded(text + ";", ("duplicate_object",)))
    for role, member, admin in sorted(set(members)):
        if member in own:
            out.append(f"GRANT {quote_ident(role)} TO {quote_ident(member)}{' WITH ADMIN OPTION' if admin else ''};")
    return out


@dataclass
class Argument:
    type: str
    name: str = ""
    mode: str = "i"
    default: str = ""


def function_sql(name: str, args: Sequence[Argument], returns: str, language: str, body: str, volatility: str = "v", strict: bool = False, definer: bool = False, kind: str = "f", returns_set: bool = False) -> str:
    """CREATE FUNCTION or PROCEDURE; names and modes of all arguments are kept."""
    modes = {"i": "", "o": "OUT ", "b": "INOUT ", "v": "VARIADIC "}
    shown = [modes[a.mode] + (quote_ident(a.name) + " " if a.name else "") + a.type + (f" DEFAULT {a.default}" if a.default else "") for a in args if a.mode in modes]
    columns = [(quote_ident(a.name) + " " if a.name else "") + a.type for a in args if a.mode == "t"]
    if kind == "p":
        head = f"CREATE OR REPLACE PROCEDURE {name}({', '.join(shown)})"
    else:
        result = f"TABLE({', '.join(columns)})" if columns else ("SETOF " if returns_set else "") + returns
        head = f"CREATE OR REPLACE FUNCTION {name}({', '.join(shown)}) RETURNS {result}"
    options = [f"LANGUAGE {language}"]
    if kind != "p":
        options += [{"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}[volatility], *(["STRICT"] if strict else [])]
    if definer:
        options.append("SECURITY DEFINER")
    return f"{head} {' '.join(options)} AS {dollar_quote(body)};"


def trigger_sql(name: str, table: str, function: str, bits: int, columns: Sequence[str] = (), when: str = "", args: Sequence[str] = (), constraint: bool = False) -> str:
    """CREATE TRIGGER from the bits of its type: 1 row, 2 before, 4 insert, 8 delete, 16 update, 32 truncate, 64 instead."""
    timing = "BEFORE" if bits & 2 else "INSTEAD OF" if bits & 64 else "AFTER"
    events = [word for bit, word in ((4, "INSERT"), (8, "DELETE"), (16, "UPDATE" + (f" OF {', '.join(map(quote_ident, columns))}" if columns else "")), (32, "TRUNCATE")) if bits & bit]
    text = f"CREATE {'CONSTRAINT ' if constraint else ''}TRIGGER {quote_ident(name)} {timing} {' OR '.join(events)} ON {table} FOR EACH {'ROW' if bits & 1 else 'STATEMENT'}"
    return text + (f" WHEN ({when})" if when else "") + f" EXECUTE FUNCTION {function}({', '.join(map(quote_literal, args))});"


def view_sql(name: str, query: str, materialized: bool = False, needs: Sequence[str] = ()) -> str:
    """A view; without its text a comment names what it depends on."""
    if not query:
        return f"-- view {name} depends on: {', '.join(sorted(set(needs))) or 'nothing known'}"
    return f"CREATE {'MATERIALIZED ' if materialized else ''}VIEW {name} AS {query.rstrip(';')};"


def schema_sql(names: Iterable[str]) -> list[str]:
    """CREATE SCHEMA of those that aren't part of every database."""
    system = ("pg_catalog", "pg_toast", "information_schema", "public")
    return [f"CREATE SCHEMA IF NOT EXISTS {quote_ident(n)};" for n in sorted(set(names)) if n not in system and not n.startswith(("pg_temp_", "pg_toast_temp_"))]
