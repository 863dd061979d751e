"""Filters over groups, selections in them, and what they amount to."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.operators.graph import numbered


def parse_terms(value: str, *, path: bool = False) -> list[tuple[str, bool]]:
    """(term, excluded) of a comma-separated filter.

    Double quotes keep commas in a term, a leading - excludes, a leading + takes the rest as it stands, blanks are
    passed over; with ``path`` backslashes become slashes. A lone sign or an open quote is an error.
    """
    fields, now, quoted = [], "", False
    for c in value:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append(now)
            now = ""
        else:
            now += c
    if quoted:
        raise ValueError("a quotation mark is not closed")
    out = []
    for field in (f.strip() for f in [*fields, now]):
        if not field:
            continue
        sign, term = (field[0], field[1:].strip()) if field[0] in "+-" else ("", field)
        if not term:
            raise ValueError("a sign needs a term after it")
        out.append(((term.replace("\\", "/") if path else term).casefold(), sign == "-"))
    return out


def parse_size(value: str, unit: int) -> Decimal | None:
    """Bytes of a decimal number in units of 1024 ** unit; None if blank."""
    value = value.strip()
    if not value:
        return None
    if not re.fullmatch(r"[0-9]+(\.[0-9]*)?|\.[0-9]+", value):
        raise ValueError(f"{value} is no size")
    return Decimal(value) * 1024**unit


def size_bounds(least: str, least_unit: int, most: str, most_unit: int) -> tuple[Decimal | None, Decimal | None]:
    low, high = parse_size(least, least_unit), parse_size(most, most_unit)
    if low is not None and high is not None and low > high:
        raise ValueError("the least size is above the most")
    return low, high


def _terms(text: Column, terms: list[tuple[str, bool]]) -> Column:
    out = F.lit(True)
    for term, excluded in terms:
        has = F.contains(paths.casefold(text), F.lit(term))
        out = out & (~has if excluded else has)
    return out


def matches(file_name: str = "", folder: str = "", whole_path: str = "", bounds: tuple = (None, None)) -> Column:
    """Whether one file meets every part of a filter."""
    p = F.col("path")
    out = _terms(paths.name(p), parse_terms(file_name)) & _terms(paths.parent(p), parse_terms(folder, path=True)) & _terms(p, parse_terms(whole_path, path=True))
    low, high = bounds
    if low is not None:
        out = out & (F.col("size") >= F.lit(low))
    if high is not None:
        out = out & (F.col("size") <= F.lit(high))
    return out


def visible_groups(members: DataFrame, condition: Column) -> DataFrame:
    """All members of the groups in which one and the same file meets the condition."""
    hit = members.where(condition).select("group_id").distinct()
    return members.join(hit, "group_id", "left_semi")


def of_category(members: DataFrame, category: str | None) -> DataFrame:
    """Rows of one file category; what groups amount to is worked out before."""
    return members if category is None else members.where(paths.file_type(F.col("path")) == category)


def selected_groups(members: DataFrame, selection: DataFrame) -> DataFrame:
    """Whole groups that hold a selected file."""
    return visible_groups(members.join(selection.select("path", F.lit(True).alias("_on")), "path", "left"), F.col("_on")).drop("_on")


def numbered_groups(groups: DataFrame) -> DataFrame:
    """``groups`` with group_no from 1, by recoverable bytes, then id."""
    return numbered(groups, F.desc("extra_bytes"), F.col("group_id")).withColumnRenamed("row", "group_no")


def sorted_groups(groups: DataFrame, by: str, *, descending: bool = False) -> DataFrame:
    """Numbered ``groups`` with their place from 1 by a column; equal ones keep the order of their numbers."""
    return numbered(groups, F.desc(by) if descending else F.asc(by), F.col("group_no")).withColumnRenamed("row", "place")


def size_range(least: Column, most: Column) -> Column:
    """One size, or the least and the most."""
    low, high = paths.format_bytes(least), paths.format_bytes(most)
    return F.when(least == most, low).otherwise(F.concat(low, F.lit(" – "), high))


def summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("extra_bytes"), F.lit(0)).cast("long").alias("extra_bytes"), F.coalesce(F.bool_or(~F.col("contents_verified")), F.lit(False)).alias("any_unverified"))


def selection_state(members: DataFrame, selection: DataFrame) -> DataFrame:
    """Per group: n_files, n_selected, n_remaining, all_selected."""
    on = members.join(selection.select("path", F.lit(1).alias("_on")).distinct(), "path", "left")
    out = on.groupBy("group_id").agg(F.count("*").alias("n_files"), F.count("_on").alias("n_selected"))
    return out.withColumn("n_remaining", F.col("n_files") - F.col("n_selected")).withColumn("all_selected", F.col("n_remaining") == 0)


def selection_summary(members: DataFrame, selection: DataFrame, visible: DataFrame) -> DataFrame:
    """One row: selected files, their bytes, the groups they are in, and how many of them a filter hides."""
    chosen = members.join(selection.select("path").distinct(), "path", "left_semi")
    shown = chosen.join(visible.select("path", F.lit(1).alias("_shown")).distinct(), "path", "left")
    return shown.agg(F.count("*").alias("n_selected"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_distinct("group_id").alias("n_groups"), F.count_if(F.col("_shown").isNull()).alias("n_hidden"))


def select_all(shown: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection and every member that is shown."""
    return selection.select("path").unionByName(shown.select("path")).distinct()


def cleared(selection: DataFrame, shown: DataFrame) -> DataFrame:
    """The selection without what is shown; what a filter hides stays selected."""
    return selection.select("path").distinct().join(shown.select("path").distinct(), "path", "left_anti")


def select_in_folder(members: DataFrame, selection: DataFrame, folder: str) -> DataFrame:
    """The selection and a folder's duplicates, one copy of every group left: an unselected one first, then the least path."""
    on = members.join(selection.select("path", F.lit(1).alias("_on")).distinct(), "path", "left")
    inside = paths.is_within(F.col("path"), F.lit(folder))
    state = on.groupBy("group_id").agg(F.count_if(F.col("_on").isNull() & ~inside).alias("_kept"), F.min(F.when(inside, F.struct(F.col("_on").isNotNull().alias("s"), F.col("path").alias("p")))).alias("_spare"))
    wanted = on.join(state, "group_id").where(inside & ((F.col("_kept") > 0) | (F.col("path") != F.col("_spare.p"))))
    spared = on.join(state, "group_id").where(inside & (F.col("_kept") == 0) & (F.col("path") == F.col("_spare.p"))).select("path")
    return selection.select("path").unionByName(wanted.select("path")).distinct().join(spared, "path", "left_anti")


def surviving_selection(selection: DataFrame, members: DataFrame) -> DataFrame:
    return selection.join(members.select("path").distinct(), "path", "left_semi")
