"""Visibility of heap tuples from hint bits and the commit log, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of t_infomask as PostgreSQL defines them.
XMIN_COMMITTED, XMIN_INVALID = 0x100, 0x200
XMAX_COMMITTED, XMAX_INVALID = 0x400, 0x800
XMAX_LOCK_ONLY, XMAX_IS_MULTI = 0x80, 0x1000
#: Xids below this are always committed.
FIRST_NORMAL_XID = 3
#: delete_certain(): the hint bits leave the delete to the commit log.
XMAX_OPEN = 2


def has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def clog_latest(clog: DataFrame) -> DataFrame:
    """The latest status of each xid: xid, status. Among equal seen_ts the highest status; NULL xids are left out."""
    return clog.where("xid is not null").groupBy("xid").agg(F.max_by("status", F.struct("seen_ts", "status")).alias("status"))


def insert_known(mask: Column, xmin: Column) -> Column:
    """Whether the insert holds as far as the hint bits and fixed xids tell; NULL: ask the commit log."""
    return (
        F.when(has(mask, XMIN_COMMITTED), F.lit(True))
        .when(has(mask, XMIN_INVALID), F.lit(False))
        .when(xmin < FIRST_NORMAL_XID, F.lit(True))
    )


def delete_certain(mask: Column, xmax: Column) -> Column:
    """0: not deleted, 1: deleted, XMAX_OPEN: the commit log decides."""
    return (
        F.when(has(mask, XMAX_INVALID | XMAX_LOCK_ONLY), 0)
        .when(has(mask, XMAX_IS_MULTI | XMAX_COMMITTED), 1)
        .when(xmax == 0, 0)
        .otherwise(XMAX_OPEN)
    )


def visibility(mask: Column, xmax: Column, xmin_status: Column | None = None, xmax_status: Column | None = None, xmin: Column | None = None) -> Column:
    """State of a tuple: `aborted`, `live`, `deleted` or `suspected` (the delete is unknown).

    Without statuses only hint bits count. With the commit log an insert that it calls aborted or in progress is
    `aborted`, even where the delete is unknown.
    """
    aborted = has(mask, XMIN_INVALID) & ~has(mask, XMIN_COMMITTED)
    if xmin_status is not None:
        unhinted = ~has(mask, XMIN_INVALID | XMIN_COMMITTED)
        if xmin is not None:
            unhinted = unhinted & (xmin >= FIRST_NORMAL_XID)
        aborted = aborted | (unhinted & F.coalesce(xmin_status.isin(0, 2), F.lit(False)))
    certain = delete_certain(mask, xmax)
    state = F.when(aborted, F.lit("aborted")).when(certain == 0, F.lit("live")).when(certain == 1, F.lit("deleted"))
    if xmax_status is not None:
        state = state.when((xmax < FIRST_NORMAL_XID) | xmax_status.isin(1, 3), F.lit("deleted")).when(xmax_status == 2, F.lit("live"))
    return state.otherwise(F.lit("suspected"))


def admitted(state: Column, mode: str = "live") -> Column:
    """Filter of a scan mode: `live` (live and suspected), `all` (whatever isn't aborted), `deleted` (deleted and suspected)."""
    if mode == "live":
        return state.isin("live", "suspected")
    if mode == "all":
        return state != "aborted"
    if mode == "deleted":
        return state.isin("deleted", "suspected")
    raise ValueError(f"unknown mode {mode!r}; use live, all or deleted")


def deleted_mark(state: Column) -> Column:
    """Marker of a row in the modes that show deleted rows; empty for live ones."""
    return F.when(state == "deleted", F.lit("DELETED")).when(state == "suspected", F.lit("SUSPECTED_DELETED")).otherwise(F.lit(""))
