"""Ordered analytics that stay balanced when one key holds most of the rows.

A plain window partitioned by flow puts a whole flow in one task.  Here each
flow is cut into slices of its order (time, sequence number or record number).
Rows are windowed inside (key, slice); one summary row per slice is carried
forward along the key; the two are combined.  The result equals the plain
window, yet the largest task holds one slice.

Combining costs a second computing of the rows and a join.  Keys of few rows,
which are most, are one slice (`schema.WHOLE`) and get the plain window.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark import schema as S

BROADCAST_ROWS = 500_000


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast only when a count proves it small; larger ones join by shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def with_slice_width(df: DataFrame, keys: list[str], ts: str = "ts_us", rows: int = S.SLICE_ROWS, width_us: int = S.SLICE_US,
                     counts: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Add slice_us: the usual width (or `whole`, the key undivided), or for keys of more than `rows` rows one so narrow that no slice holds more.

    The width of a busy key follows its densest stretch, not its mean: its rows
    are counted per millisecond and those counts summed to tenfold widths, of
    which the widest without an overfull slice is taken.  Idle time makes no
    slices, so narrow slices cost nothing there.  Busy keys are few (all rows /
    `rows` at most), so the table of their widths is small and no row is
    shuffled for it.  `counts` (keys, _n) saves the count where the caller has
    it; keys of fewer rows may be left out of it.
    """
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    many = counts.filter(F.col("_n") > rows).select(*keys)
    found = many.limit(BROADCAST_ROWS + 1).count()
    usual = F.lit(S.WHOLE if whole else width_us).cast("bigint")
    if not found:
        return df.withColumn("slice_us", usual)
    many = F.broadcast(many) if found <= BROADCAST_ROWS else many
    unit = min(1000, width_us)
    fine = df.join(many, keys, "left_semi").groupBy(*keys, F.floor(F.col(ts) / unit).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    ladder = [w for w in (width_us // 10**i for i in range(12)) if w >= unit]
    sums = (fine.withColumn("_w", F.explode(F.array(*[F.lit(w).cast("bigint") for w in ladder])))
            .groupBy(*keys, "_w", F.floor(F.col("_bin") * unit / F.col("_w"))).agg(F.sum("_n").alias("_n"))
            .groupBy(*keys, "_w").agg(F.max("_n").alias("_most")))
    # A millisecond that is overfull itself is cut at each microsecond.
    busy = sums.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_most") <= rows, F.col("_w"))), F.lit(1).cast("bigint")).alias("_narrow"))
    return (df.join(bounded(busy), keys, "left")
            .withColumn("slice_us", F.coalesce("_narrow", usual)).drop("_narrow"))


def sliced(messages: DataFrame, keys: list[str], ts: str = "ts_us") -> DataFrame:
    """Messages with slice_us, found here where the caller has not."""
    return messages if "slice_us" in messages.columns else with_slice_width(messages, keys, ts, whole=True)


def time_slice(df: DataFrame, ts: str = "ts_us") -> Column:
    """Start of a row's slice of time, of the row's own width where it has one."""
    width = F.col("slice_us") if "slice_us" in df.columns else F.lit(S.SLICE_US).cast("bigint")
    return F.col(ts) - F.pmod(F.col(ts), width)


def by_width(df: DataFrame, keys: list[str], slice_: Column) -> tuple[DataFrame, DataFrame | None]:
    """Rows of divided keys, and those of whole keys where the rows tell.

    A row without a key or slice takes no part, as it finds none in the join.
    """
    if "slice_us" not in df.columns:
        return df, None
    told = slice_.isNotNull()
    for k in keys:
        told = told & F.col(k).isNotNull()
    return df.filter(F.col("slice_us") < S.WHOLE), df.filter((F.col("slice_us") >= S.WHOLE) & told)


@dataclass(frozen=True)
class Prior:
    """A value over the rows strictly before the current one.

    kind: "lag" (previous row), "last" (previous non-null), "sum", "max", "min".
    """
    name: str
    kind: str
    value: Column


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def with_priors(df: DataFrame, keys: list[str], order: list[str], slice_: Column, priors: list[Prior],
                descending: bool = False, divided: bool = False) -> DataFrame:
    """Add one column per prior.  `slice_` must not run against `order`.

    `divided` cuts all keys by `slice_`, for keys that are not those of `slice_us`.
    """
    lags = [p for p in priors if p.kind == "lag"]
    df, whole = (df, None) if divided else by_width(df, keys, slice_)
    df = df.withColumn("_slice", slice_)
    df = df.withColumns({f"_v_{p.name}": p.value for p in priors})

    def by(names):
        return [F.desc(n) if descending else F.asc(n) for n in names]

    local = Window.partitionBy(*keys, "_slice").orderBy(*by(order))
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(*by(["_slice"])).rowsBetween(Window.unboundedPreceding, -1)

    place = F.struct(*order)
    edge = F.min_by if descending else F.max_by

    here, total, carried, merged = {}, [], {}, {}
    if lags:
        pack = F.struct(*[F.col(f"_v_{p.name}").alias(p.name) for p in lags])
        here["_h_lag"] = F.lag(pack).over(local)
        total.append(edge(pack, place).alias("_t_lag"))
        carried["_c_lag"] = F.last("_t_lag").over(across)
        for p in lags:
            merged[p.name] = F.coalesce(F.col("_h_lag"), F.col("_c_lag"))[p.name]
    for p in priors:
        v, h, t, c = (f"_{x}_{p.name}" for x in "vhtc")
        if p.kind == "last":
            here[h] = F.last(v, ignorenulls=True).over(before)
            total.append(edge(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(t))
            carried[c] = F.last(t, ignorenulls=True).over(across)
            merged[p.name] = F.coalesce(h, c)
        elif p.kind != "lag":
            fold = _MERGE[p.kind]
            here[h] = fold(v).over(before)
            total.append(fold(v).alias(t))
            carried[c] = fold(t).over(across)
            if p.kind == "sum":
                zero = F.lit(0)
                merged[p.name] = F.coalesce(F.col(h), zero) + F.coalesce(F.col(c), zero)
            else:
                merged[p.name] = (F.greatest if p.kind == "max" else F.least)(h, c)

    slices = df.groupBy(*keys, "_slice").agg(*total).withColumns(carried)
    slices = slices.select(*keys, "_slice", *carried)
    helper = ["_slice", *(f"_v_{p.name}" for p in priors), *here, *carried]
    out = df.withColumns(here).join(slices, [*keys, "_slice"]).withColumns(merged).drop(*helper)
    if whole is None:
        return out
    line = Window.partitionBy(*keys).orderBy(*by(order))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    plain = {"lag": lambda v: F.lag(v).over(line), "last": lambda v: F.last(v, ignorenulls=True).over(before),
             "sum": lambda v: F.coalesce(F.sum(v).over(before), F.lit(0)), "max": lambda v: F.max(v).over(before), "min": lambda v: F.min(v).over(before)}
    whole = whole.withColumns({f"_v_{p.name}": p.value for p in priors}).withColumns({p.name: plain[p.kind](F.col(f"_v_{p.name}")) for p in priors})
    return out.unionByName(whole.drop(*[f"_v_{p.name}" for p in priors]))


def with_steps(df: DataFrame, keys: list[str], order: list[str], slice_: Column, value: Column,
               step: Callable[[Column, Column], Column], name: str, first: int = 0, previous: str | None = None) -> DataFrame:
    """Add `name`: the sum of step(value before, value) over a key's rows up to this one; `first` stands for its first row.

    `value` is a struct.  Steps are summed inside the slice; slices are chained
    by the step from one slice's last value to the next one's first, so a
    border and the number of borders before it come from one pass.  `previous`
    names a column for the value before.
    """
    df, whole = by_width(df, keys, slice_)
    df = df.withColumns({"_slice": slice_, "_value": value})
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_slice")
    place = F.struct(*order)

    def taken(before, at, otherwise):
        moved = F.coalesce(step(F.col(before), F.col(at)).cast("bigint"), F.lit(0))
        return F.when(F.col(before).isNull(), F.lit(otherwise)).otherwise(moved).cast("bigint")

    rows = df.withColumn("_before", F.lag("_value").over(local)).withColumn("_step", taken("_before", "_value", 0))
    rows = rows.withColumn("_here", F.sum("_step").over(upto))
    slices = (rows.groupBy(*keys, "_slice")
              .agg(F.min_by("_value", place).alias("first"), F.max_by("_value", place).alias("last"), F.sum("_step").alias("moved"))
              .withColumn("_carried", F.lag("last").over(across)).withColumn("jump", taken("_carried", "first", first))
              .withColumn("_base", F.sum("jump").over(across)
                          + F.coalesce(F.sum("moved").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(*keys, "_slice", "_base", "_carried"))
    out = rows.join(slices, [*keys, "_slice"]).withColumn(name, F.col("_base") + F.col("_here"))
    if previous:
        out = out.withColumn(previous, F.coalesce("_before", "_carried"))
    out = out.drop("_slice", "_value", "_before", "_step", "_here", "_base", "_carried")
    if whole is None:
        return out
    line = Window.partitionBy(*keys).orderBy(*order)
    whole = whole.withColumn("_value", value).withColumn("_before", F.lag("_value").over(line)).withColumn("_step", taken("_before", "_value", first))
    whole = whole.withColumn(name, F.sum("_step").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    if previous:
        whole = whole.withColumn(previous, F.col("_before"))
    return out.unionByName(whole.drop("_value", "_before", "_step"))


def unwrap(df: DataFrame, keys: list[str], order: list[str], slice_: Column, value: str, name: str,
           modulus: int = 1 << 32) -> DataFrame:
    """Add `name`: a 32-bit circular counter as a running distance from the key's first value.

    Each step is the signed circular distance to the previous row, so a stream
    may pass any number of wraps.
    """
    half = modulus // 2

    def distance(a, b):
        return F.pmod(b["at"] - a["at"] + half, F.lit(modulus)) - half

    return with_steps(df, keys, order, slice_, F.struct(F.col(value).alias("at")), distance, name)


BATCH_ROWS = 4096


def arrow_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def grouped(rows: DataFrame, keys: list[str], each: Callable[[list[tuple]], list[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Keys and what `each` makes of the other columns of every group's rows, as tuples of `fields`.

    The rows of a task are sorted by their keys, so a group is a run of them
    and many small groups share an Arrow batch, where a call a group would cost
    more than its rows.  A task holds one group.
    """
    values = [c for c in rows.columns if c not in keys]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, *[n for n, _, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, made, kinds = None, [], [], None
        for batch in batches:
            kinds = kinds or [*[batch.schema.field(k).type for k in keys], *[t for _, t, _ in fields]]
            for key, value in zip(zip(*(batch[k].to_pylist() for k in keys)), zip(*(batch[c].to_pylist() for c in values))):
                if key != at:
                    made += [(*at, *r) for r in each(group)] if group else []
                    at, group = key, []
                    if len(made) >= BATCH_ROWS:
                        yield arrow_rows(made, names, kinds)
                        made = []
                group.append(value)
        made += [(*at, *r) for r in each(group)] if group else []
        if made:
            yield arrow_rows(made, names, kinds)

    columns = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{n} {d}" for n, _, d in fields]])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, columns)
