"""Statements that make a database again, from its catalogs: DataFrames of one row a statement, joined on the executors and
written by the builders of pagewright.ddl. Steps give the order: schemas, types, sequences, tables, keys, indexes, the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.ddl import objects as O
from pagewright.ddl.nodetree import Deparser, partition_bound, quote_ident, type_text
from pagewright.functions.decode import OIDS
from pagewright.operators.catalog import FIRST_USER_OID
from pagewright.operators.objects import is_builtin_role, role_grants, view_dependencies

if TYPE_CHECKING:
    from pagewright.sources.bootstrap import Cluster

STATEMENT = "oid bigint, step int, name string, statement string"
#: Steps of a script: each kind of object comes after those it needs.
SCHEMA, TYPE, DOMAIN, SEQUENCE, TABLE, PARTITION, COMMENT, OWNED, INDEX, KEY, FUNCTION, TRIGGER, VIEW = range(13)
# Oids of the catalogs that comments and dependencies name.
_CLASS, _ATTRDEF, _PROC = 1259, 2604, 1255


def numbers(column: Column | str, separator: str = " ") -> Column:
    """An array of numbers from the text of a vector (`1 2`) or array (`{1,2}`); NULL stays NULL."""
    text = F.translate(F.col(column) if isinstance(column, str) else column, "{}", "")
    return F.filter(F.transform(F.split(text, separator), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def written(df: DataFrame, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The statements that `make` gives for each row of df: tuples (oid, step, name, statement)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [s for row in batch.itertuples(index=False) for s in make(row)]
            yield pd.DataFrame(rows, columns=["oid", "step", "name", "statement"])

    return df.mapInPandas(run, STATEMENT)


def _items(value) -> list:
    """A list of structs or values as pandas gives it, or nothing."""
    return [] if value is None or isinstance(value, float) else list(value)


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def user_relations(cluster: Cluster) -> DataFrame:
    return cluster.relations().where(F.col("oid") >= FIRST_USER_OID)


def described_columns(cluster: Cluster) -> DataFrame:
    """Columns of each relation in order, with type names, defaults and the sequences these need: attrelid, columns."""
    rows = cluster.columns()
    types = cluster.types().select(F.col("oid").alias("atttypid"), F.col("typname"))
    defaults = cluster.optional("pg_attrdef").groupBy(F.col("adrelid").alias("attrelid"), F.col("adnum").cast("int").alias("attnum")).agg(F.max_by(F.struct("oid", "adbin"), F.struct("_page", "_item")).alias("d"))
    defaults = defaults.select("attrelid", "attnum", F.col("d.oid").alias("def_oid"), F.col("d.adbin").alias("adbin"))
    needs = cluster.optional("pg_depend").where((F.col("classid") == _ATTRDEF) & (F.col("refclassid") == _CLASS)).select(F.col("objid").alias("def_oid"), F.col("refobjid").alias("oid")).distinct()
    sequences = cluster.relations().where("relkind = 'S'").select("oid", F.concat_ws(".", "schema_name", "relname").alias("sequence"))
    named = needs.join(sequences, "oid").groupBy("def_oid").agg(F.sort_array(F.collect_list(F.struct("oid", "sequence"))).alias("sequences"))
    comments = cluster.optional("pg_description").where((F.col("classoid") == _CLASS) & (F.col("objsubid") > 0)).groupBy(F.col("objoid").alias("attrelid"), F.col("objsubid").alias("attnum")).agg(F.max("description").alias("comment"))
    rows = rows.withColumn("attnum", F.col("attnum").cast("int")).join(types, "atttypid", "left")
    rows = rows.join(defaults, ["attrelid", "attnum"], "left").join(named, "def_oid", "left").join(comments, ["attrelid", "attnum"], "left")
    one = F.struct("attnum", "attname", "atttypid", "atttypmod", "attnotnull", "attidentity", "attgenerated", "attisdropped", "typname", "adbin", "sequences", "comment")
    return rows.groupBy("attrelid").agg(F.sort_array(F.collect_list(one)).alias("columns"))


def constraints(cluster: Cluster, kinds: str) -> DataFrame:
    """Constraints of some kinds (c, f, p, u, x), the last row of each oid, keys as arrays."""
    rows = cluster.optional("pg_constraint").where(F.col("contype").isin(*kinds))
    keep = ["conname", "contype", "conrelid", "contypid", "conindid", "confrelid", "condeferrable", "condeferred", "convalidated", "confupdtype", "confdeltype", "conkey", "confkey", "conexclop", "conbin"]
    rows = rows.groupBy("oid").agg(F.max_by(F.struct(*keep), F.struct("_page", "_item")).alias("r")).select("oid", "r.*")
    return rows.withColumn("conkey", numbers("conkey", ",")).withColumn("confkey", numbers("confkey", ","))


def indexes(cluster: Cluster) -> DataFrame:
    """Current rows of pg_index, vectors as arrays."""
    rows = cluster.optional("pg_index").withColumn("expressions", F.col("indexprs")).withColumn("predicate", F.col("indpred"))
    keep = ["indrelid", "indnkeyatts", "indisunique", "indisprimary", "indisexclusion", "indkey", "indoption", "expressions", "predicate"]
    rows = rows.groupBy("indexrelid").agg(F.max_by(F.struct(*keep), F.struct("_page", "_item")).alias("r")).select("indexrelid", "r.*")
    return rows.withColumn("indkey", numbers("indkey")).withColumn("indoption", numbers("indoption"))


def _names(columns) -> list[str]:
    """Names by attribute number, from 1 on; dropped and unknown ones are empty but keep their place."""
    out: list[str] = []
    for c in columns:
        out += [""] * (c["attnum"] - 1 - len(out)) + ["" if c["attisdropped"] else c["attname"] or ""]
    return out


def _sequences(columns) -> dict[int, str]:
    return {s["oid"]: s["sequence"] for c in columns for s in _items(c["sequences"])}


def _sql_type(c, modifier: str = "atttypmod") -> str:
    oid, name = c["atttypid"], c["typname"]
    return type_text(oid, c[modifier], {oid: name} if name and oid not in OIDS else None)


def table_statements(cluster: Cluster) -> DataFrame:
    """CREATE TABLE of every table, partition parents and partitions included, and the comments on it."""
    tables = user_relations(cluster).where(F.col("relkind").isin("r", "p"))
    primary = constraints(cluster, "p").groupBy(F.col("conrelid").alias("oid")).agg(F.max_by("conkey", F.struct(F.size("conkey"), -F.col("oid"))).alias("key"))
    # without its constraint a primary key is known by its index, the widest one
    by_index = indexes(cluster).where("indisprimary").withColumn("k", F.slice("indkey", F.lit(1), F.when(F.col("indnkeyatts") > 0, F.col("indnkeyatts").cast("int")).otherwise(F.size("indkey"))))
    by_index = by_index.groupBy(F.col("indrelid").alias("oid")).agg(F.max_by("k", F.struct(F.size("k"), -F.col("indexrelid"))).alias("index_key"))
    checks = constraints(cluster, "c").groupBy(F.col("conrelid").alias("oid")).agg(F.sort_array(F.collect_list(F.struct("conname", "conbin"))).alias("checks"))
    split = cluster.optional("pg_partitioned_table").groupBy(F.col("partrelid").alias("oid")).agg(F.max(F.struct("partstrat", "partattrs", "partexprs")).alias("p"))
    names = tables.select(F.col("oid").alias("parent"), F.col("schema_name").alias("parent_schema"), F.col("relname").alias("parent_name"))
    above = cluster.partitions().where("bound is not null").groupBy(F.col("id").alias("oid")).agg(F.min(F.struct("seqno", "parent", "bound")).alias("up"))
    above = above.select("oid", "up.parent", "up.bound").join(names, "parent", "left").drop("parent")
    comments = cluster.optional("pg_description").where((F.col("classoid") == _CLASS) & (F.col("objsubid") == 0)).groupBy(F.col("objoid").alias("oid")).agg(F.max("description").alias("comment"))
    rows = tables.join(described_columns(cluster).withColumnRenamed("attrelid", "oid"), "oid", "left")
    for side in (primary, by_index, checks, split, above, comments):
        rows = rows.join(side, "oid", "left")

    def make(r):
        columns = [c for c in _items(r.columns)]
        names, expressions = _names(columns), Deparser(_names(columns), sequences=_sequences(columns))
        made = []
        for c in columns:
            default = expressions.text(c["adbin"]) if c["adbin"] else ""
            stored = c["attgenerated"] == "s"
            made.append(O.Column(c["attname"], _sql_type(c), bool(c["attnotnull"]), "" if stored else default, c["attidentity"] or "", default if stored else "", "", bool(c["attisdropped"]), c["comment"] or ""))
        known = lambda nums: [names[n - 1] for n in nums if 0 < n <= len(names) and names[n - 1]]
        key = known(_items(r.key) or _items(r.index_key))
        by, by_columns = "", []
        if r.p is not None:
            attributes = [int(x) for x in (r.p["partattrs"] or "").split()]
            made_of = iter(expressions.list(r.p["partexprs"]) if r.p["partexprs"] else [])
            by_columns = known(attributes)
            by = O.partition_clause(r.p["partstrat"], [quote_ident(names[n - 1]) if n else f"({next(made_of, '')})" for n in attributes if n <= len(names)])
        of = O.qualified(_text(r.parent_schema), r.parent_name) if _text(r.parent_name) else ""
        bound = partition_bound(r.bound) if of else ""
        checks = {c["conname"]: expressions.text(c["conbin"] or "") for c in _items(r.checks)}
        table = O.Table(r.relname, r.schema_name, made, key, by, of if bound else "", bound, checks=checks, comment=_text(r.comment))
        first, *rest = [s for s in O.table_sql(table, by_columns) if not s.startswith("--")]
        notes = [s for s in O.table_sql(table, by_columns) if s.startswith("--")]
        yield r.oid, PARTITION if of and bound else TABLE, f"{r.schema_name}.{r.relname}", "\n".join([*notes, first])
        for i, s in enumerate(rest):
            yield r.oid, COMMENT, f"{r.schema_name}.{r.relname} {i:05}", s

    return written(rows, make)


def index_statements(cluster: Cluster) -> DataFrame:
    """CREATE INDEX of every index that no constraint makes; oid is the table's."""
    relations = cluster.relations()
    made = constraints(cluster, "pux").select(F.col("conindid").alias("indexrelid"))
    rows = indexes(cluster).where("not indisprimary").join(made, "indexrelid", "left_anti")
    rows = rows.join(relations.select(F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name")), "indexrelid")
    rows = rows.join(user_relations(cluster).select(F.col("oid").alias("indrelid"), "schema_name", "relname"), "indrelid")
    rows = rows.join(described_columns(cluster).withColumnRenamed("attrelid", "indrelid"), "indrelid")

    def make(r):
        names = _names(_items(r.columns))
        expressions = Deparser(names)
        texts = iter(expressions.list(r.expressions) if _text(r.expressions) else [])
        number = int(r.indnkeyatts) or len(r.indkey)
        options = [int(x) for x in _items(r.indoption)]
        keys, complete = [], True
        for i, n in enumerate(int(x) for x in r.indkey):
            text = (quote_ident(names[n - 1]) if names[n - 1] else "") if 0 < n <= len(names) else f"({t})" if n == 0 and (t := next(texts, "")) else ""
            complete &= bool(text)
            flag = options[i] if i < len(options) else 0
            # descending indexes begin with NULLs, ascending ones end with them, unless it is said
            order = (" DESC" if flag & 1 else "") + ("" if bool(flag & 1) == bool(flag & 2) else " NULLS FIRST" if flag & 2 else " NULLS LAST")
            keys.append(text + (order if i < number else ""))
        where = expressions.text(r.predicate) if _text(r.predicate) else ""
        table = O.qualified(r.schema_name, r.relname)
        if complete and (where or not _text(r.predicate)):
            include = [names[int(n) - 1] for n in list(r.indkey)[number:]]
            text = O.index_sql(r.index_name, table, keys[:number], bool(r.indisunique), include=include, where=where)
        else:
            text = f"-- index {r.index_name} on {table} can't be written as SQL"
        yield r.indrelid, INDEX, f"{r.schema_name}.{r.index_name}", text

    return written(rows, make)


def key_statements(cluster: Cluster) -> DataFrame:
    """ALTER TABLE of unique constraints and foreign keys; oid is the table's. Foreign keys to unknown tables are comments."""
    rows = constraints(cluster, "uf")
    own, target = described_columns(cluster), described_columns(cluster)
    relations = user_relations(cluster).select("oid", "schema_name", "relname")
    rows = rows.join(relations.select(F.col("oid").alias("conrelid"), "schema_name", "relname"), "conrelid")
    rows = rows.join(own.select(F.col("attrelid").alias("conrelid"), "columns"), "conrelid")
    rows = rows.join(relations.select(F.col("oid").alias("confrelid"), F.col("schema_name").alias("to_schema"), F.col("relname").alias("to_name")), "confrelid", "left")
    rows = rows.join(target.select(F.col("attrelid").alias("confrelid"), F.col("columns").alias("to_columns")), "confrelid", "left")

    def make(r):
        table, names = O.qualified(r.schema_name, r.relname), _names(_items(r.columns))
        columns = [names[int(n) - 1] if 0 < n <= len(names) else "" for n in _items(r.conkey)]
        if r.contype == "u":
            text = f"ALTER TABLE {table} ADD CONSTRAINT {quote_ident(r.conname)} UNIQUE ({', '.join(map(quote_ident, columns))});" if all(columns) else ""
        else:
            there = _names(_items(r.to_columns))
            others = [there[int(n) - 1] if 0 < n <= len(there) else "" for n in _items(r.confkey)]
            known = _text(r.to_name) and columns and all(columns) and all(others)
            text = O.foreign_key_sql(r.conname, table, columns, O.qualified(_text(r.to_schema), r.to_name), others, r.confdeltype, r.confupdtype, bool(r.convalidated), bool(r.condeferrable), bool(r.condeferred)) if known else ""
        yield r.conrelid, KEY, f"{r.contype} {r.schema_name}.{r.relname}.{r.conname} {r.oid}", text or f"-- constraint {r.conname} on {table} can't be written as SQL"

    return written(rows, make)


def type_statements(cluster: Cluster) -> DataFrame:
    """CREATE TYPE of enums and row types of their own, CREATE DOMAIN."""
    types = cluster.types()
    named = types.join(cluster.namespaces().withColumnRenamed("relnamespace", "typnamespace"), "typnamespace", "left").withColumn("schema_name", F.coalesce("schema_name", F.lit("public")))
    named = named.where(F.col("oid") >= FIRST_USER_OID)
    labels = cluster.optional("pg_enum").groupBy(F.col("enumtypid").alias("oid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda e: e["enumlabel"]).alias("labels"))
    enums = named.where("typtype = 'e'").join(labels, "oid", "left").select("oid", "schema_name", "typname", "labels")
    checks = constraints(cluster, "c").where("contypid <> 0").groupBy(F.col("contypid").alias("oid")).agg(F.sort_array(F.collect_list(F.struct("conname", "conbin"))).alias("checks"))
    bases = types.select(F.col("oid").alias("typbasetype"), F.col("typname").alias("base_name"))
    domains = named.where("typtype = 'd'").join(bases, "typbasetype", "left").join(checks, "oid", "left").select("oid", "schema_name", "typname", "typbasetype", "base_name", "typtypmod", "typnotnull", "typdefaultbin", "typdefault", "checks")
    rows_ = cluster.classes().where("relkind = 'c'").select(F.col("reltype").alias("oid"), F.col("oid").alias("attrelid"))
    rows_ = named.where("typtype = 'c'").join(rows_, "oid").join(described_columns(cluster), "attrelid", "left").select("oid", "schema_name", "typname", "columns")

    def make_enum(r):
        yield r.oid, TYPE, f"{r.schema_name}.{r.typname}", O.enum_sql(O.qualified(r.schema_name, r.typname), _items(r.labels))

    def make_domain(r):
        base = type_text(r.typbasetype, r.typtypmod, {r.typbasetype: r.base_name} if _text(r.base_name) else None)
        expressions = Deparser()
        checks = {c["conname"]: t for c in _items(r.checks) if (t := expressions.text(c["conbin"] or ""))}
        default = (expressions.text(r.typdefaultbin) if _text(r.typdefaultbin) else "") or _text(r.typdefault)
        yield r.oid, DOMAIN, f"{r.schema_name}.{r.typname}", O.domain_sql(O.qualified(r.schema_name, r.typname), base, bool(r.typnotnull), default, checks)

    def make_row(r):
        fields = [(c["attname"], _sql_type(c)) for c in _items(r.columns) if not c["attisdropped"]]
        yield r.oid, TYPE, f"{r.schema_name}.{r.typname}", O.composite_sql(O.qualified(r.schema_name, r.typname), fields)

    return written(enums, make_enum).unionByName(written(domains, make_domain)).unionByName(written(rows_, make_row))


def sequence_statements(cluster: Cluster, states: DataFrame | None = None) -> DataFrame:
    """CREATE SEQUENCE with its owner; with states (oid, last_value, is_called) setval as well."""
    own = user_relations(cluster).where("relkind = 'S'").select("oid", "schema_name", "relname")
    kept = cluster.optional("pg_sequence").groupBy(F.col("seqrelid").alias("oid")).agg(F.max_by(F.struct("seqtypid", "seqstart", "seqincrement", "seqmax", "seqmin", "seqcache", "seqcycle"), F.struct("_page", "_item")).alias("s"))
    owner = cluster.optional("pg_depend").where((F.col("classid") == _CLASS) & (F.col("refclassid") == _CLASS) & F.col("deptype").isin("a", "i") & (F.col("refobjsubid") > 0)).groupBy(F.col("objid").alias("oid")).agg(F.min(F.struct("refobjid", "refobjsubid")).alias("o"))
    owner = owner.select("oid", F.col("o.refobjid").alias("attrelid"), F.col("o.refobjsubid").alias("attnum"))
    columns = cluster.columns().select("attrelid", F.col("attnum").cast("int").alias("attnum"), F.col("attname").alias("owner_column"))
    tables = cluster.relations().select(F.col("oid").alias("attrelid"), F.col("schema_name").alias("owner_schema"), F.col("relname").alias("owner_table"))
    rows = own.join(kept, "oid").join(owner.join(columns, ["attrelid", "attnum"]).join(tables, "attrelid").drop("attrelid", "attnum"), "oid", "left")
    states = cluster.spark.createDataFrame([], "oid bigint, last_value bigint, is_called boolean") if states is None else states
    rows = rows.join(states.withColumn("last_value", F.col("last_value").cast("string")), "oid", "left")

    def make(r):
        name, s = O.qualified(r.schema_name, r.relname), r.s
        owned = f"{O.qualified(r.owner_schema, r.owner_table)}.{quote_ident(r.owner_column)}" if _text(r.owner_column) else ""
        last = int(r.last_value) if _text(r.last_value) else None
        texts = O.sequence_sql(name, s["seqstart"], s["seqincrement"], s["seqmin"], s["seqmax"], s["seqcache"], bool(s["seqcycle"]), type_text(s["seqtypid"]), last, bool(r.is_called) if r.is_called is not None else True, owned)
        for i, text in enumerate(texts):
            yield r.oid, SEQUENCE if i == 0 else OWNED, f"{r.schema_name}.{r.relname} {i}", text

    return written(rows, make)


def function_statements(cluster: Cluster) -> DataFrame:
    """CREATE FUNCTION or PROCEDURE of user functions in SQL and procedural languages."""
    rows = cluster.optional("pg_proc").where(F.col("oid") >= FIRST_USER_OID)
    languages = cluster.optional("pg_language").select(F.col("oid").alias("prolang"), "lanname").distinct()
    rows = rows.join(cluster.namespaces().withColumnRenamed("relnamespace", "pronamespace"), "pronamespace", "left").join(languages, "prolang", "left")
    types = F.array_distinct(F.concat(numbers("proargtypes"), F.coalesce(numbers("proallargtypes", ","), F.array().cast("array<bigint>")), F.array("prorettype")))
    asked = rows.select(F.col("oid").alias("fn"), F.explode(types).alias("oid")).join(cluster.types().select("oid", "typname"), "oid").groupBy("fn").agg(F.collect_list(F.struct("oid", "typname")).alias("names"))
    rows = rows.join(asked, rows["oid"] == asked["fn"], "left").withColumn("inputs", numbers("proargtypes")).withColumn("all_types", numbers("proallargtypes", ","))
    rows = rows.withColumn("modes", F.split(F.translate("proargmodes", "{}", ""), ",")).select("oid", "schema_name", "proname", "lanname", "prosrc", "prokind", "provolatile", "proisstrict", "prosecdef", "proretset", "prorettype", "pronargdefaults", "proargdefaults", "inputs", "all_types", "modes", "proargnames", "names")

    def make(r):
        from pagewright.functions.containers import parse_array

        names = {n["oid"]: n["typname"] for n in _items(r.names) if n["oid"] not in OIDS}
        kinds = [int(x) for x in (_items(r.all_types) or _items(r.inputs))]
        called = parse_array(r.proargnames) if _text(r.proargnames) else []
        modes = _items(r.modes)
        args = [O.Argument(type_text(k, -1, names), called[i] or "" if i < len(called) else "", modes[i] if i < len(modes) else "i") for i, k in enumerate(kinds)]
        given = Deparser().list(r.proargdefaults) if _text(r.proargdefaults) else []
        inputs = [a for a in args if a.mode in ("i", "b", "v")]
        for a, text in zip(inputs[len(inputs) - len(given) :], given):
            a.default = text
        name = O.qualified(_text(r.schema_name) or "public", r.proname)
        text = O.function_sql(name, args, type_text(r.prorettype, -1, names), _text(r.lanname) or "sql", _text(r.prosrc), r.provolatile, bool(r.proisstrict), bool(r.prosecdef), r.prokind, bool(r.proretset))
        yield r.oid, FUNCTION, f"{_text(r.schema_name)}.{r.proname} {r.oid}", text

    return written(rows, make)


def trigger_statements(cluster: Cluster) -> DataFrame:
    """CREATE TRIGGER of those that aren't internal; oid is the table's."""
    rows = cluster.optional("pg_trigger").where("not tgisinternal")
    functions = cluster.optional("pg_proc").join(cluster.namespaces().select(F.col("relnamespace").alias("pronamespace"), F.col("schema_name").alias("fn_schema")), "pronamespace", "left").select(F.col("oid").alias("tgfoid"), "fn_schema", "proname")
    rows = rows.join(user_relations(cluster).select(F.col("oid").alias("tgrelid"), "schema_name", "relname"), "tgrelid").join(functions, "tgfoid", "left")
    rows = rows.join(described_columns(cluster).withColumnRenamed("attrelid", "tgrelid"), "tgrelid", "left").withColumn("of", numbers("tgattr"))
    rows = rows.select("tgrelid", "tgname", "tgtype", "schema_name", "relname", "fn_schema", "proname", "columns", "of", "tgargs", "tgqual", "tgconstraint")

    def make(r):
        names, table = _names(_items(r.columns)), O.qualified(r.schema_name, r.relname)
        when = Deparser(names).text(r.tgqual) if _text(r.tgqual) else ""
        args = [a.decode("utf-8", "replace") for a in bytes(r.tgargs or b"").split(b"\0")[:-1]]
        if not _text(r.proname) or (_text(r.tgqual) and not when):
            text = f"-- trigger {r.tgname} on {table} can't be written as SQL"
        else:
            text = O.trigger_sql(r.tgname, table, O.qualified(_text(r.fn_schema) or "public", r.proname), int(r.tgtype), [names[int(n) - 1] for n in _items(r.of) if 0 < n <= len(names)], when, args, bool(r.tgconstraint))
        yield r.tgrelid, TRIGGER, f"{r.schema_name}.{r.relname}.{r.tgname}", text

    return written(rows, make)


def view_statements(cluster: Cluster) -> DataFrame:
    """Views as comments that name what they depend on: their trees hold no text."""
    views = user_relations(cluster).where(F.col("relkind").isin("v", "m"))
    rules = cluster.optional("pg_rewrite").select(F.col("oid").alias("objid"), F.col("ev_class").alias("view"))
    edges = cluster.optional("pg_depend").where(F.col("refclassid") == _CLASS).join(rules, "objid").select(F.col("view").alias("objid"), "refobjid")
    needs = view_dependencies(views, edges, cluster.relations())
    rows = views.join(needs, "oid", "left").select("oid", "schema_name", "relname", "relkind", "needs")

    def make(r):
        yield r.oid, VIEW, f"{r.schema_name}.{r.relname}", O.view_sql(O.qualified(r.schema_name, r.relname), "", r.relkind == "m", _items(r.needs))

    return written(rows, make)


def schema_statements(cluster: Cluster) -> DataFrame:
    """CREATE SCHEMA of those that aren't part of every database."""
    rows = cluster.namespaces().withColumnRenamed("relnamespace", "oid").where(F.col("oid") >= FIRST_USER_OID)

    def make(r):
        for text in O.schema_sql([r.schema_name]):
            yield r.oid, SCHEMA, r.schema_name, text

    return written(rows, make)


def relation_statements(cluster: Cluster) -> DataFrame:
    """The statements of tables: themselves, comments, indexes and keys: oid, step, name, statement."""
    return reduce(DataFrame.unionByName, (table_statements(cluster), index_statements(cluster), key_statements(cluster)))


def database_statements(cluster: Cluster) -> DataFrame:
    """All statements that make the database again, to be run in order of step, then name."""
    parts = (schema_statements, type_statements, sequence_statements, relation_statements, function_statements, trigger_statements, view_statements)
    return reduce(DataFrame.unionByName, (part(cluster) for part in parts))


def role_statements(cluster: Cluster, with_password: bool = True) -> DataFrame:
    """CREATE ROLE of all roles but built-in ones (step 0) and their memberships (step 1)."""
    roles = cluster.roles()
    own = roles.where(~is_builtin_role(F.col("oid"), F.col("rolname")))
    members = cluster.optional("pg_auth_members").select("roleid", "member", "admin_option")

    def make(r):
        role = O.Role(r.rolname, r.oid, bool(r.rolsuper), bool(r.rolinherit), bool(r.rolcreaterole), bool(r.rolcreatedb), bool(r.rolcanlogin), bool(r.rolreplication), bool(r.rolbypassrls), int(r.rolconnlimit), _text(r.rolpassword), _text(r.rolvaliduntil))
        for text in O.role_sql([role], (), with_password):
            yield r.oid, 0, r.rolname, text

    def grant(r):
        yield 0, 1, f"{r.role} {r.member}", f"GRANT {quote_ident(r.role)} TO {quote_ident(r.member)}{' WITH ADMIN OPTION' if r.admin_option else ''};"

    return written(own, make).unionByName(written(role_grants(members, roles), grant))
