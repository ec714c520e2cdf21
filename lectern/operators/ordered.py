"""Ordered operators that don't need a whole key in one task.

A window over ``PARTITION BY key`` sends all rows of a key to one task. Here a
key's rows are cut into blocks of the ordering column; windows run within
(key, block), and what crosses a block's edge - the last or first row, the sum
or the count so far - is carried by a table with one row for each block, over
which a window by key is cheap. A key that holds a third of all rows is then
spread over as many tasks as it has blocks.

Rows whose key or order is null take no part; callers filter or count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut


def blocked(df: DataFrame, keys: list[str], order: str, width: int, block: str = "__block") -> DataFrame:
    """Adds the block number and brings each (key, block) into one partition; what has a block already stays as it is."""
    if block in df.columns:
        return df
    df = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in [*keys, order])))
    return df.withColumn(block, F.floor(F.col(order) / F.lit(width)).cast("long")).repartition(*keys, block)


def with_neighbor(df: DataFrame, keys: list[str], order: list[str], cols: list[str], name: str, forward: bool = False, block: str = "__block") -> DataFrame:
    """Adds struct ``name`` of ``cols`` of the row before (or after) within the key.

    ``df`` comes from :func:`blocked`. ``order`` must tell the key's rows apart,
    and must not contradict the blocks. No neighbour: null.
    """
    parts = [*keys, block]
    shift, edge = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    inner = F.struct(*cols)
    seen = df.withColumn(name, shift(inner).over(Window.partitionBy(*parts).orderBy(*order)))
    edges = df.groupBy(*parts).agg(edge(inner, F.struct(*order)).alias("__edge"))
    edges = edges.select(*parts, shift("__edge").over(Window.partitionBy(*keys).orderBy(block)).alias("__far"))
    seen = seen.join(edges, parts, "left")
    return seen.withColumn(name, F.coalesce(name, "__far")).drop("__far")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: str = "sum", backward: bool = False, block: str = "__block") -> DataFrame:
    """Adds ``name``: the sum, max or min of ``value`` over the key's rows up to
    this one, or from this one on if ``backward``. ``df`` comes from :func:`blocked`."""
    parts = [*keys, block]
    f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    df = df.withColumn("__value", value)
    flow = [F.desc(c) for c in order] if backward else order
    inner = Window.partitionBy(*parts).orderBy(*flow).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(F.desc(block) if backward else F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*parts).agg(f("__value").alias("__part"))
    sums = sums.select(*parts, f("__part").over(before).alias("__base"))
    out = df.withColumn(name, f("__value").over(inner)).join(sums, parts, "left")
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[how]
    return out.withColumn(name, both(F.col(name), F.col("__base"))).drop("__base", "__value")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: str = "__block") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows up to this one."""
    return running(df, keys, order, value, name, block=block)


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], width: int, cols: list[str], same: Column, first: list[str], last: list[str], live: Column | None = None) -> DataFrame:
    """One row for each maximal run of rows of a key in ``order``.

    ``order[0]`` is a number by which blocks of ``width`` are cut. ``same`` says,
    in terms of the row and of struct ``prev`` (``cols`` of the row before),
    whether a row goes on with the run of the row before; a row without one
    begins a run. Rows that aren't ``live`` belong to no run and end it.

    Only boundary rows are kept: those that begin a run, or that aren't live
    and follow one that is. The distance of their positions is a run's length,
    and what the next boundary row knows of its predecessor is the run's end.
    One pass over a block's rows finds them, but for its first row, which is
    kept until the block before is known; so is its last row, which tells the
    next block. All else is done on what was kept.
    Result: keys, ``first_<c>`` for c in ``first``, ``last_<c>`` for c in
    ``last``, ``n``. Nulls in ``order[0]`` or a key: the row is left out.
    """
    live = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    carry = list(dict.fromkeys([*cols, *last, "__live"]))
    goes_on = F.col("__live") & F.coalesce(F.col("prev.__live"), F.lit(False)) & F.coalesce(same, F.lit(False))
    is_cut = ~goes_on & (F.col("__live") | F.coalesce(F.col("prev.__live"), F.lit(False)))
    parts = [*keys, "__block"]
    inner = Window.partitionBy(*parts).orderBy(*order)
    rows = blocked(df, keys, order[0], width).withColumn("__live", live)
    rows = rows.withColumn("prev", F.lag(F.struct(*carry)).over(inner)).withColumn("__cut", is_cut)
    # a window over __cut: so it is worked out once, below the filter
    rows = rows.withColumn("__end", F.lead("__cut").over(inner).isNull()).withColumn("__pos", F.row_number().over(inner).cast("long"))
    needed = list(dict.fromkeys([*parts, *order, *cols, *first, *last, "__live", "prev", "__pos", "__end", "__cut"]))
    rows = cut(rows.where("__cut or __end or __pos = 1").select(*needed))
    # one row for each block: its size, and the last row before it
    each = Window.partitionBy(*keys).orderBy("__block")
    blocks = rows.where("__end").select(*parts, F.col("__pos").alias("__n"), F.struct(*carry).alias("__tail"))
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("__n").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("__far", F.lag("__tail").over(each)).withColumn("__last", F.lead("__block").over(each).isNull())
    rows = rows.join(blocks, parts)
    rows = rows.withColumn("prev", F.when(F.col("__pos") == 1, F.col("__far")).otherwise(F.col("prev"))).withColumn("__cut", F.when(F.col("__pos") == 1, is_cut).otherwise(F.col("__cut")))
    at = F.col("__pos") + F.col("__base")
    # the end of a key counts as a boundary after its last row
    here = F.array_compact(F.array(
        F.when(F.col("__cut"), F.struct(at.alias("pos"), F.col("__live").alias("live"), F.struct(*[F.col(f"prev.{c}").alias(c) for c in last]).alias("before"), F.struct(*first).alias("first"))),
        F.when(F.col("__end") & F.col("__last"), F.struct((at + 1).alias("pos"), F.lit(False).alias("live"), F.struct(*last).alias("before"), F.lit(None).cast(rows.select(F.struct(*first).alias("x")).schema["x"].dataType).alias("first"))),
    ))
    bounds = rows.select(*parts, F.explode(here).alias("b"))
    bounds = with_neighbor(bounds.select(*parts, "b.*"), keys, ["pos"], ["pos", "before"], "next", forward=True)
    out = bounds.where("live and next is not null")
    return out.select(*keys, *[F.col(f"first.{c}").alias(f"first_{c}") for c in first], *[F.col(f"next.before.{c}").alias(f"last_{c}") for c in last], (F.col("next.pos") - F.col("pos")).alias("n"))
