"""Rows as INSERT statements, CSV lines and COPY text, built by native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import quote_ident
from pagewright.plans.lineage import materialize

# The escapes of COPY text, in the order in which they are made.
COPY_ESCAPES = (("\\", "\\\\"), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\x0b", "\\v"), ("\x0c", "\\f"), ("\r", "\\r"))
#: Rows that are numbered together when statements are batched.
BATCH_CHUNK = 100_000


def as_text(df: DataFrame, column: str) -> Column:
    """The canonical text of a column: booleans as t and f, others as Spark casts them."""
    if df.schema[column].dataType.simpleString() == "boolean":
        return F.when(F.col(column), "t").when(~F.col(column), "f")
    return F.col(column).cast("string")


def _plain(df: DataFrame, column: str, delimiter: str) -> bool:
    """Whether a column's text can hold nothing that needs quoting or escaping."""
    kind = df.schema[column].dataType.simpleString()
    return delimiter in ",;|\t" and (kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal"))


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """One CSV field: NULL is `\\N`, an empty text an empty cell; delimiters, quotes, line ends and the markers `\\N` and
    `\\.` are quoted."""
    special = value.contains(delimiter) | value.contains('"') | value.contains("\n") | value.contains("\r") | value.isin("\\N", "\\.")
    return F.when(value.isNull(), "\\N").when(special, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_line(df: DataFrame, columns: Sequence[str], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[F.coalesce(as_text(df, c), F.lit("\\N")) if _plain(df, c, delimiter) else csv_field(as_text(df, c), delimiter) for c in columns])


def csv_header(columns: Sequence[str], delimiter: str = ",") -> str:
    """Header line; names are quoted where fields would be."""
    quote = lambda n: '"' + n.replace('"', '""') + '"' if delimiter in n or set('"\r\n') & set(n) else n
    return delimiter.join(map(quote, columns))


def copy_field(value: Column, delimiter: str = "\t") -> Column:
    """One field of COPY text: NULL is `\\N`; backslash and controls are escaped, then another delimiter."""
    text = value
    for char, escape in COPY_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    if delimiter not in [c for c, _ in COPY_ESCAPES]:
        text = F.replace(text, F.lit(delimiter), F.lit("\\" + delimiter))
    return F.when(value.isNull(), "\\N").otherwise(text)


def copy_line(df: DataFrame, columns: Sequence[str], delimiter: str = "\t") -> Column:
    return F.concat_ws(delimiter, *[F.coalesce(as_text(df, c), F.lit("\\N")) if _plain(df, c, delimiter) else copy_field(as_text(df, c), delimiter) for c in columns])


def text_literal(value: Column, oracle_empty: bool = False) -> Column:
    """A text as SQL literal: NULL, '...' with quotes doubled, E'...' where there are backslashes or controls.

    oracle_empty: an empty text becomes an expression that stays empty in Oracle mode, where '' means NULL.
    """
    escaped = value
    for char, escape in COPY_ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit(escape))
    doubled = F.replace(escaped, F.lit("'"), F.lit("''"))
    special = value.rlike(r"[\\\x08-\x0d]")
    out = F.when(value.isNull(), "NULL")
    if oracle_empty:
        out = out.when(value == "", "convert_from('\\x', 'UTF8')")
    return out.when(special, F.concat(F.lit("E'"), doubled, F.lit("'"))).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def literal(df: DataFrame, column: str, oracle_empty: bool = False) -> Column:
    """A column as SQL literal: finite numbers bare, everything else as text literal."""
    kind = df.schema[column].dataType.simpleString()
    text = as_text(df, column)
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.coalesce(text, F.lit("NULL"))
    if kind in ("float", "double"):
        odd = F.isnan(column) | F.col(column).isin(float("inf"), float("-inf"))
        return F.when(F.col(column).isNull(), "NULL").when(odd, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
    return text_literal(text, oracle_empty)


def insert_prefix(table: str, columns: Sequence[str] | None = None, schema: str | None = None) -> str:
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    name = f"{quote(schema)}.{quote(table)}" if schema else quote(table)
    names = f" ({', '.join(map(quote, columns))})" if columns else ""
    return f"INSERT INTO {name}{names} VALUES "


def insert_values(df: DataFrame, columns: Sequence[str], oracle_empty: bool = False) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[literal(df, c, oracle_empty) for c in columns]), F.lit(")"))


def insert_line(df: DataFrame, table: str, columns: Sequence[str], complete: bool = True, oracle_empty: bool = False) -> Column:
    """One INSERT statement per row."""
    return F.concat(F.lit(insert_prefix(table, columns if complete else None)), insert_values(df, columns, oracle_empty), F.lit(";"))


def insert_batches(df: DataFrame, table: str, columns: Sequence[str], order: Sequence[str], size: int, breaks: Column | None = None, lead: Column | None = None) -> DataFrame:
    """Multi-row INSERT statements: batch (from 0, in `order`), n_rows, statement.

    At most `size` rows make a statement, and a row for which `breaks` holds begins one by itself and is followed by
    another; `lead` is put before such a statement. Rows are placed without a global window: sorted by range over all partitions, counted per partition, and
    the counts of the partitions before (one row each) are added.
    """
    breaks = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    placed = df.select(*order, insert_values(df, columns).alias("v_"), breaks.alias("alone_"), (F.lit("") if lead is None else F.coalesce(lead, F.lit(""))).alias("lead_"))
    placed = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p_", F.spark_partition_id()).withColumn("i_", F.monotonically_increasing_id()))
    # islands: a run of rows between breaks; its rows are numbered within the run
    within = Window.partitionBy("p_").orderBy("i_")
    marked = placed.withColumn("n_", F.row_number().over(within)).withColumn("b_", F.sum(F.col("alone_").cast("bigint")).over(within))
    sums = marked.groupBy("p_").agg(F.max("n_").alias("rows_"), F.max("b_").alias("breaks_"), F.max(F.when(F.col("alone_"), F.col("n_"))).alias("last_break_"))
    before = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = sums.withColumn("rows_before", F.coalesce(F.sum("rows_").over(before), F.lit(0))).withColumn("breaks_before", F.coalesce(F.sum("breaks_").over(before), F.lit(0)))
    sums = sums.withColumn("break_at", F.max(F.col("rows_before") + F.col("last_break_")).over(before))
    rows = marked.join(F.broadcast(sums.select("p_", "rows_before", "breaks_before", "break_at")), "p_")
    rows = rows.withColumn("pos", F.col("rows_before") + F.col("n_")).withColumn("island", F.col("breaks_before") + F.col("b_"))
    own = F.max(F.when(F.col("alone_"), F.col("pos"))).over(within)
    start = F.coalesce(own, "break_at", F.lit(0))
    rows = rows.withColumn("in_run", F.col("pos") - start)  # 0: the breaking row, from 1: rows after it
    rows = rows.withColumn("part", F.when(F.col("alone_"), F.lit(-1)).otherwise(F.floor((F.col("in_run") - 1) / size)).cast("bigint"))
    made = rows.groupBy("island", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.coalesce(F.max(F.when(F.col("alone_"), F.col("lead_"))), F.lit("")).alias("lead_"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v_"))), lambda r: r["v_"]), ", ").alias("values_"))
    return made.select("first_pos", "n_rows", F.concat("lead_", F.lit(insert_prefix(table, columns)), F.col("values_"), F.lit(";")).alias("statement"))


def quoted_name(schema: Column, table: Column) -> Column:
    return F.concat(F.when(schema.isNotNull(), F.concat(quote_ident(schema), F.lit("."))).otherwise(""), quote_ident(table))
