"""Listings: filters, search, order, pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, LARGEST_PAGE = 50, 200


def contains_text(column: Column, wanted: str | None) -> Column:
    """Case-insensitive substring; no filter for None.  Wildcards are plain characters."""
    return F.lit(True) if wanted is None else F.coalesce(F.contains(F.lower(column), F.lit(wanted.lower())), F.lit(False))


def search(columns: list[Column], wanted: str | None) -> Column:
    """Any of the columns contains the text."""
    found = contains_text(columns[0], wanted)
    for c in columns[1:]:
        found = found | contains_text(c, wanted)
    return found


def in_list_text(items: Column, wanted: str) -> Column:
    """Substring of the list written as JSON: `rock` finds `punk_rock`."""
    return F.coalesce(F.contains(F.lower(F.to_json(items)), F.lit(wanted.lower())), F.lit(False))


def same_place(column: Column, wanted: str | None) -> Column:
    """A place matches unless both are known and differ."""
    return F.lit(True) if not (wanted or "").strip() else (F.coalesce(F.trim(column), F.lit("")) == "") | (F.lower(F.trim(column)) == wanted.strip().lower())


def page(rows: DataFrame, order: list[Column], limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A page in this order, which must be total."""
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {LARGEST_PAGE} and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def totals(rows: DataFrame, visible: Column, reasons: dict[str, Column] | None = None) -> DataFrame:
    """One row: total (visible), full_total, excluded and the count of each reason, in one pass."""
    n = F.count_if(visible)
    return rows.agg(n.alias("total"), F.count("*").alias("full_total"), (F.count("*") - n).alias("excluded"), *[F.count_if(c).alias(k) for k, c in (reasons or {}).items()])


def with_flag(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with whether others have a row of the key."""
    return rows.join(others.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str], most: int | None = None) -> DataFrame:
    """parents with their children as an ordered list, empty for none."""
    rest = [*order, *[c for c in children.columns if c != key and c not in order]]
    if most is not None:  # ranked first, so no more than these are gathered
        w = Window.partitionBy(key).orderBy(*rest)
        children = children.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in order."""
    return rows.select(column).filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").distinct().orderBy(column)
