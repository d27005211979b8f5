"""Per-user ordered operators that stay balanced when one user holds most of the log.

A plain ``Window.partitionBy("user_id")`` puts a whole user into one task. A
:class:`Timeline` keeps that plan for ordinary users and cuts the few that exceed
``max_rows_per_slice`` into consecutive time slices, and an instant that is too full into
ranges of the rest of the order. A window then runs per (user, slice, part), and what one
part must know of the others (its last row, its sums) is taken from a small aggregate of
each part that is joined back on it. Both plans give the same result: null users, nulls in
a ``by`` column and null times, which come first, are groups like others.

The log is shuffled once, by (user, slice, part); every window below reuses that layout.
The per-slice aggregates are read from a table of the cut users' rows that is written
once, and never from the chain of windows itself.

What to compute is declared as a :class:`Stage`. Stages merge, and columns that share a
sort order then share one window operator.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.config import ScaleConfig
from riskline.functions.scalar import micros
from riskline.session import CUT_SETTINGS, materialize

# The user as a text that is never null, the slice's first microsecond, and the part of it.
WHO, SLICE, PART = "_who", "_slice", "_part"


def _text(*columns: str) -> Column:
    """One text for the values of the columns, different for different ones, also for nulls.

    A join on it finds nulls too, and unlike a null-safe join it keeps the layout of the log.
    """
    value = lambda c: F.col(c).cast("string")
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c))) for c in columns]
    return F.concat(F.lit(""), *parts)


# Rows without a time stand before all others.
NO_TIME = -(1 << 63)
# Rows of an overfull instant that its ranges are taken from, about.
SAMPLE = 1024
# A slice that is too full is divided into this many times the parts its count asks for.
FINER = 8


@dataclass(frozen=True)
class Previous:
    """``value`` of the nearest earlier row of (user, *by), or later if ``ahead``.

    Without a value it is the time itself. With ``where`` only such rows are looked at, and
    of these only those with a value.
    """

    value: Column | None = None
    by: tuple[str, ...] = ()
    where: Column | None = None
    ahead: bool = False


@dataclass(frozen=True)
class Context:
    """The ``depth`` previous values of a string column, oldest first; null where fewer exist."""

    value: str
    depth: int
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Running:
    """Sum over the rows of (user, *by) up to and including the row."""

    value: Column
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Total:
    """Sum, minimum or maximum over all rows of (user, *by), copied to each of them."""

    fn: Callable[..., Column]
    value: Column
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Level:
    """Units present in a closed trailing window.

    A row adds ``enter`` units at its own time and takes ``leave`` units away one
    microsecond after ``micros_back`` has passed.
    """

    enter: Column
    leave: Column
    micros_back: int


Spec = Previous | Context | Running | Total


@dataclass(frozen=True)
class Stage:
    """Columns over each user's time order, listed in the order they are computed.

    ``keys`` are derived grouping columns. ``grouped`` specs have a ``by``. ``levels`` and
    ``whole`` specs (over the user alone) may use what ``grouped`` computes, ``early``
    columns and ``second`` specs also those, ``late`` columns everything. Only early and
    late columns remain.
    """

    keys: Mapping[str, Column] = field(default_factory=dict)
    grouped: Mapping[str, Spec] = field(default_factory=dict)
    levels: Mapping[str, Level] = field(default_factory=dict)
    whole: Mapping[str, Spec] = field(default_factory=dict)
    early: Mapping[str, Column] = field(default_factory=dict)
    second: Mapping[str, Spec] = field(default_factory=dict)
    late: Mapping[str, Column] = field(default_factory=dict)

    def __or__(self, other: Stage) -> Stage:
        return Stage(
            {**self.keys, **other.keys},
            {**self.grouped, **other.grouped},
            {**self.levels, **other.levels},
            {**self.whole, **other.whole},
            {**self.early, **other.early},
            {**self.second, **other.second},
            {**self.late, **other.late},
        )


@dataclass(frozen=True)
class Timeline:
    key: str = "user_id"
    order: tuple[str, ...] = ("timestamp", "event_id")
    # Users that are cut, one row each: the user, _t0 and _width in microseconds.
    large: DataFrame | None = None
    # Slices that were still too large, level by level: user, _slice, _finer (new width).
    bursts: tuple[DataFrame, ...] = ()
    # Instants that are too large: user, _slice, and where its parts begin.
    instants: DataFrame | None = None
    # The rows of the cut users, as stored and with their slice.
    stored: DataFrame | None = None
    # Tasks the log is laid out over; left to adaptive execution where the cores are enough.
    tasks: int | None = None

    @classmethod
    def plan(
        cls,
        events: DataFrame,
        scale: ScaleConfig = ScaleConfig(),
        key: str = "user_id",
        order: Sequence[str] = ("timestamp", "event_id"),
    ) -> Timeline:
        """Find the users that need slices: one narrow pass, partially aggregated."""
        order = tuple(order)
        us = micros(order[0])
        users = events.groupBy(_text(key).alias(WHO)).agg(
            F.count(F.lit(1)).alias("_n"), F.min(us).alias("_t0"), F.max(us).alias("_t1")
        )
        users = materialize(users, "users")
        large = users.filter(F.col("_n") > scale.max_rows_per_slice)
        rows, total = users.agg(F.sum("_n"), F.sum(F.when(F.col("_n") > scale.max_rows_per_slice, F.col("_n")))).first()
        # Adaptive execution goes by stored bytes, and a task's sorts hold many times those: it would give a task
        # more rows the larger the log is.
        tasks = -(-(rows or 0) // scale.rows_per_task)
        if tasks <= events.sparkSession.sparkContext.defaultParallelism:
            tasks = None
        if total is None:
            return cls(key, order, tasks=tasks)
        for name, value in CUT_SETTINGS.items():
            events.sparkSession.conf.set(name, value)

        # Every large user has more than `size` rows, so there are fewer than
        # total / size of them: this bounds the broadcasts below.
        size = max(scale.max_rows_per_slice, total // scale.max_broadcast_rows + 1)
        width = F.ceil((F.col("_t1") - F.col("_t0") + 1) * F.lit(float(size)) / F.col("_n"))
        large = large.filter(F.col("_n") > size).select(
            WHO,
            F.coalesce("_t0", F.lit(0)).alias("_t0"),
            F.greatest(width, F.lit(1)).cast("long").alias("_width"),
        )
        timeline = cls(key, order, large, tasks=tasks)
        mine = timeline._with_who(events).join(F.broadcast(large.select(WHO)), WHO, "left_semi")
        stored = materialize(mine.drop(WHO), "cut-users")
        timeline = replace(timeline, stored=stored)

        # Equal spans of time hold equal shares of a steady user. Where events come in
        # bursts, divide the spans that are too full. Each division makes a span shorter,
        # so this ends, at the latest with instants.
        while True:
            spans = timeline._spans(stored.select(key, *order))
            full = spans.groupBy(WHO, SLICE, "_span").agg(F.count(F.lit(1)).alias("_n"))
            full = materialize(full.filter(F.col("_n") > size), "bursts")
            wide = full.filter(F.col("_span") > 1)
            if wide.isEmpty():
                break
            finer = F.ceil(F.col("_span") * F.lit(float(size)) / (F.col("_n") * FINER))
            finer = F.least(F.greatest(finer, F.lit(1)), F.col("_span") - 1).cast("long")
            timeline = replace(timeline, bursts=(*timeline.bursts, wide.select(WHO, SLICE, finer.alias("_finer"))))
        if len(order) > 1 and not full.isEmpty():
            # Evenly spaced values of a sample, so an instant's parts are even up to chance.
            rest = F.struct(*order[1:])
            share = F.ceil(F.col("_n") / SAMPLE)
            drawn = spans.join(F.broadcast(full), [WHO, SLICE]).filter(F.pmod(F.xxhash64(*order[1:]), share) == 0)
            step = F.greatest(F.lit(1), F.floor(F.size("_all") * F.lit(size) / F.col("_n"))).cast("int")
            cuts = F.filter("_all", lambda _, i: (i > 0) & (i % F.col("_step") == 0))
            instants = drawn.groupBy(WHO, SLICE, "_n").agg(F.array_sort(F.collect_set(rest)).alias("_all"))
            instants = instants.withColumn("_step", step).select(WHO, SLICE, cuts.alias("_cuts"))
            timeline = replace(timeline, instants=materialize(instants, "instants"))
        return timeline

    @property
    def sliced(self) -> bool:
        return self.large is not None

    @property
    def keys(self) -> list[str]:
        if not self.sliced:
            return [self.key]
        return [WHO, SLICE] if self.instants is None else [WHO, SLICE, PART]

    @property
    def cut(self) -> DataFrame:
        """The rows of the cut users with their slice."""
        return self.assign(self.stored)

    def _with_who(self, df: DataFrame) -> DataFrame:
        return df.withColumn(WHO, _text(self.key))

    def _spans(self, df: DataFrame, at: Column | None = None) -> DataFrame:
        """Add user, the slice's first microsecond and its width, null for an uncut user."""
        at = micros(self.order[0]) if at is None else at

        def start(origin: str, width: str) -> Column:
            first = F.col(origin) + F.floor((at - F.col(origin)) / F.col(width)) * F.col(width)
            return F.coalesce(first.cast("long"), F.lit(NO_TIME))

        df = self._with_who(df.drop(WHO, SLICE, PART)).join(F.broadcast(self.large), WHO, "left")
        cut = F.col("_width").isNotNull()
        df = df.withColumns(
            {
                SLICE: F.when(cut, start("_t0", "_width")),
                "_span": F.when(at.isNull() & cut, F.lit(1)).otherwise(F.col("_width")),
            }
        ).drop("_t0", "_width")
        for level in self.bursts:
            df = df.join(F.broadcast(level), [WHO, SLICE], "left").withColumns(
                {
                    SLICE: F.when(F.col("_finer").isNull(), F.col(SLICE)).otherwise(start(SLICE, "_finer")),
                    "_span": F.coalesce("_finer", "_span"),
                }
            ).drop("_finer")
        return df

    def assign(self, df: DataFrame, at: Column | None = None) -> DataFrame:
        """Add the part of each row where users are cut."""
        if not self.sliced:
            return df
        df = self._spans(df, at).drop("_span")
        if self.instants is None:
            return df
        rest = F.struct(*self.order[1:])
        part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= rest)), F.lit(0))
        df = df.join(F.broadcast(self.instants), [WHO, SLICE], "left")
        return df.withColumn(PART, F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")

    def arrange(self, df: DataFrame, at: Column | None = None) -> DataFrame:
        """Lay the rows out by (user, slice, part): the one shuffle of the log."""
        return self._laid(self.assign(df, at))

    def _laid(self, df: DataFrame) -> DataFrame:
        return df.repartition(*([self.tasks] if self.tasks else []), *self.keys)

    def window(self, by: Sequence[str] = ()):
        return Window.partitionBy(*self.keys, *by)

    def ordered(self, by: Sequence[str] = ()):
        return self.window(by).orderBy(*self.order)

    def run(self, df: DataFrame, stage: Stage, source: DataFrame | None = None) -> DataFrame:
        """Add the columns of a stage to rows laid out by :meth:`arrange`.

        ``source`` holds the cut users' share of the rows where that is not all of theirs.
        """
        given = df.columns
        df = self._add(df.withColumns(stage.keys), stage.grouped, source, stage.keys)
        if self.sliced:
            source = (self.cut if source is None else source).withColumns(stage.keys)
            if stage.grouped and (stage.levels or stage.whole):
                source = self._add(self._laid(source), stage.grouped, source, {})
        df = self._levels(df, stage.levels, source)
        df = self._add(df, stage.whole, source, {})
        if self.sliced and stage.second:
            source = self._add(self._laid(source), stage.whole, source, {})
        # No sort follows the early columns: the windows over the whole user, before and
        # after them, share one. Apart from the late ones they also stay within what the
        # JIT compiler takes as one method.
        df = self._add(df.withColumns(stage.early), stage.second, source, {})
        df = df.withColumns(stage.late)
        added = [*stage.early, *stage.late]
        return df.select(*given, *[c for c in added if c not in given])

    def _across(self, by: Sequence[str] = ()):
        return Window.partitionBy(WHO, *by)

    def _local(self, spec: Spec) -> Column:
        """The value of a spec within the slice."""
        rows = self.ordered(spec.by)
        if isinstance(spec, Total):
            return spec.fn(spec.value).over(self.window(spec.by))
        if isinstance(spec, Running):
            return F.sum(spec.value).over(rows.rowsBetween(Window.unboundedPreceding, 0))
        if isinstance(spec, Context):
            item = F.struct(F.col(spec.value).alias("v"))
            lags = [F.lag(item, i).over(rows) for i in range(spec.depth, 0, -1)]
            return F.array_compact(F.array(*lags))
        value = F.col(self.order[0]) if spec.value is None else spec.value
        if spec.where is not None:
            before = rows.rowsBetween(Window.unboundedPreceding, -1)
            return F.last(F.when(spec.where, value), ignorenulls=True).over(before)
        # Where parts are joined, a null value must differ from no row.
        value = F.struct(value.alias("v")) if self.sliced else value
        return (F.lead if spec.ahead else F.lag)(value).over(rows)

    def _edge(self, name: str, spec: Spec) -> Column:
        """What later (or earlier) slices need of one slice."""
        if isinstance(spec, Total):
            return spec.fn(spec.value)
        if isinstance(spec, Running):
            return F.sum(spec.value)
        order = F.struct(*self.order)
        if isinstance(spec, Context):
            tail = F.concat(name, F.array(F.struct(F.col(spec.value).alias("v"))))
            full = F.slice(tail, -spec.depth, spec.depth)
            return F.max_by(F.when(F.size(tail) > spec.depth, full).otherwise(tail), order)
        value = F.col(self.order[0]) if spec.value is None else spec.value
        if spec.where is not None:
            return F.max_by(value, F.when(spec.where & value.isNotNull(), order))
        return (F.min_by if spec.ahead else F.max_by)(F.struct(value.alias("v")), order)

    def _carried(self, name: str, spec: Spec) -> Column:
        """The edges of the other slices, folded into what this slice starts from."""
        across = self._across(spec.by)
        if isinstance(spec, Total):
            return spec.fn(name).over(across)
        slices = across.orderBy(*self.keys[1:])
        if isinstance(spec, Running):
            return F.sum(name).over(slices.rowsBetween(Window.unboundedPreceding, -1))
        if isinstance(spec, Context):
            # Every slice holds at least one row, so `depth` slices reach far enough back.
            return F.flatten(F.collect_list(name).over(slices.rowsBetween(-spec.depth, -1)))
        if spec.where is not None:
            earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
            return F.last(name, ignorenulls=True).over(earlier)
        return (F.lead if spec.ahead else F.lag)(name).over(slices)

    def _joined(self, name: str, spec: Spec) -> Column:
        local, carried = F.col(name), F.col(f"_in_{name}")
        if isinstance(spec, Total):
            return F.coalesce(carried, local)
        if isinstance(spec, Running):
            return local + F.coalesce(carried, F.lit(0))
        if isinstance(spec, Context):
            return F.concat(F.coalesce(carried, F.array().cast("array<struct<v:string>>")), local)
        nearest = F.coalesce(local, carried)
        return nearest if spec.where is not None else nearest["v"]

    def _add(
        self,
        df: DataFrame,
        specs: Mapping[str, Spec],
        source: DataFrame | None,
        keys: Mapping[str, Column],
    ) -> DataFrame:
        if not specs:
            return df
        df = df.withColumns({name: self._local(spec) for name, spec in specs.items()})
        contexts = {n: s for n, s in specs.items() if isinstance(s, Context)}
        if self.sliced:
            source = (self.cut if source is None else source).withColumns(keys)
            source = source.withColumns({n: self._local(s) for n, s in contexts.items()})
            for by in dict.fromkeys(spec.by for spec in specs.values()):
                group = {n: s for n, s in specs.items() if s.by == by}
                edges = source.groupBy(*self.keys, *by).agg(
                    *[self._edge(n, s).alias(n) for n, s in group.items()]
                )
                carry = edges.select(
                    *self.keys, *by, *[self._carried(n, s).alias(f"_in_{n}") for n, s in group.items()]
                )
                # Both sides lie by (user, slice, part), so the log itself is not shuffled
                # again.
                on = [*self.keys, "_by"] if by else self.keys
                if by:
                    carry = carry.withColumn("_by", _text(*by)).drop(*by)
                    df = df.withColumn("_by", _text(*by))
                df = df.join(self._laid(carry), on, "left")
                df = df.withColumns({n: self._joined(n, s) for n, s in group.items()})
                df = df.drop("_by", *[f"_in_{n}" for n in group])
        return df.withColumns({n: self._known(n, s.depth) for n, s in contexts.items()})

    @staticmethod
    def _known(name: str, depth: int) -> Column:
        """The last values, or null if there are fewer than ``depth`` or one of them is null."""
        last = F.slice(name, -depth, depth)
        known = (F.size(name) >= depth) & F.forall(last, lambda x: x["v"].isNotNull())
        return F.when(known, F.transform(last, lambda x: x["v"]))

    def _levels(
        self, df: DataFrame, levels: Mapping[str, Level], source: DataFrame | None
    ) -> DataFrame:
        """The level of every row, ties in time included, as a running sum over its changes.

        The cost does not grow with the window: no frame is read again for each row, as
        it is for a bounded RANGE frame.
        """
        if not levels:
            return df
        us = micros(self.order[0])

        def change(at: Column, real: bool, deltas: Mapping[str, Column]) -> Column:
            moves = [deltas.get(n, F.lit(0)).cast("long").alias(n) for n in levels]
            return F.struct(at.alias("_at"), F.lit(real).alias("_real"), *moves)

        changes = [change(us, True, {n: level.enter for n, level in levels.items()})]
        for n, level in levels.items():
            later = change(us + F.lit(level.micros_back + 1), False, {n: -level.leave.cast("long")})
            changes.append(F.when(level.leave.cast("long") > 0, later))

        def explode(rows: DataFrame) -> DataFrame:
            # A departure is its place and its moves; what the row holds besides stays behind.
            place = {WHO, SLICE, PART, self.key, *self.order[1:]}
            given = rows.columns
            rows = rows.withColumn("_p", F.explode(F.array_compact(F.array(*changes))))
            narrow = [c if c in place else F.when(F.col("_p._real"), F.col(c)).alias(c) for c in given]
            return rows.select(*narrow, "_p.*")

        moved, at = explode(df), F.col("_at")
        if self.sliced:
            # A departure may belong to a later slice; an uncut user's rows are in place.
            moved = self.arrange(moved, at)
            points = explode(source).select(self.key, *self.order[1:], "_at", *levels)
            parts = self.assign(points, at).groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in levels])
            # All parts of an instant see the changes of the whole instant.
            upto = self._across().orderBy(SLICE).rangeBetween(Window.unboundedPreceding, 0)
            others = [(F.sum(n).over(upto) - F.col(n)).alias(f"_in_{n}") for n in levels]
            carry = parts.select(*self.keys, *others)
        frame = self.window().orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        out = moved.withColumns({n: F.sum(n).over(frame) for n in levels}).filter("_real")
        if self.sliced:
            out = out.join(self._laid(carry), self.keys, "left")
            out = out.withColumns({n: F.col(n) + F.coalesce(f"_in_{n}", F.lit(0)) for n in levels})
            out = out.drop(*[f"_in_{n}" for n in levels])
        return out.drop("_at", "_real")
