"""A builder for the query clauses of the language's tree: targets, grouping, order, limits per series, fill, time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.operators.rules import whitelisted
from lumenry.plans import conditions


class Query:
    """Each method returns a new query; ``df`` is the plan so far."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def sources(self, column: str, *names: str) -> Query:
        """Rows of these names, or of names with these patterns (``reg:``)."""
        return Query(self.df.filter(whitelisted(F.col(column), list(names))))

    def where(self, text: str) -> Query:
        return Query(conditions.where(self.df, text))

    def select(self, *columns: str | Column, **aliases: str | Column) -> Query:
        named = [(F.col(c) if isinstance(c, str) else c).alias(a) for a, c in aliases.items()]
        return Query(self.df.select(*columns, *named))

    def group(self, by: list[str], **targets: Column) -> Query:
        return Query(self.df.groupBy(*by).agg(*(c.alias(a) for a, c in targets.items())))

    def bucket(self, ts: str, seconds: int | None = None, auto: int | None = None, into: str = "bucket") -> Query:
        """Time buckets of a duration, or as many as ``auto`` over the time range."""
        if seconds is None:
            low, high = self.df.agg(F.unix_timestamp(F.min(ts)), F.unix_timestamp(F.max(ts))).first()
            seconds = max(1, -(-((high or 0) - (low or 0)) // (auto or 1)))
        unix = F.unix_timestamp(F.col(ts).cast("timestamp"))
        return Query(self.df.withColumn(into, unix - F.pmod(unix, F.lit(seconds))))

    def order(self, *columns: str, desc: tuple[str, ...] = ()) -> Query:
        return Query(self.df.orderBy(*(F.col(c).desc() if c in desc else F.col(c).asc() for c in columns)))

    def limit(self, n: int, offset: int = 0) -> Query:
        return Query(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def series_limit(self, series: list[str], n: int, offset: int = 0) -> Query:
        """Rows of ``n`` series after the first ``offset``; the few series kept are found first, then semi-joined."""
        few = self.df.select(*series).distinct().orderBy(*series)
        few = few.offset(offset).limit(n) if offset else few.limit(n)
        return Query(self.df.join(F.broadcast(few) if n <= 10_000 else few, series, "left_semi"))

    def after(self, column: str, value: object) -> Query:
        """Key-set pagination."""
        return Query(self.df.filter(F.col(column) > F.lit(value)))

    def time_zone(self, ts: str, zone: str) -> Query:
        return Query(self.df.withColumn(ts, F.from_utc_timestamp(ts, zone)))

    def cast(self, column: str, kind: str) -> Query:
        """``int`` or ``float``; what can't be read is null."""
        return Query(self.df.withColumn(column, F.col(column).try_cast({"int": "bigint", "float": "double"}[kind])))

    def fill(self, series: list[str], bucket: str, value: str, step: int, how: str | float | int | None) -> Query:
        """A row for each step between a series' first and last bucket; gaps get null, a constant, ``previous`` or ``linear``."""
        spans = self.df.groupBy(*series).agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
        grid = spans.select(*series, F.explode(F.sequence("_a", "_b", F.lit(step).cast("bigint"))).alias(bucket))
        rows = grid.join(self.df, [*series, bucket], "left")
        w = Window.partitionBy(*series).orderBy(bucket)
        if how == "previous":
            return Query(rows.withColumn(value, F.last(value, True).over(w)))
        if how == "linear":
            later = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            at = lambda f, over: f(F.when(F.col(value).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(value).alias("v"))), True).over(over)
            rows = rows.withColumn("_p", at(F.last, w)).withColumn("_n", at(F.first, later))
            drawn = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(bucket) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
            return Query(rows.withColumn(value, F.coalesce(F.col(value), drawn)).drop("_p", "_n"))
        return Query(rows if how is None else rows.withColumn(value, F.coalesce(F.col(value), F.lit(how))))


def enrich(df: DataFrame, dimension: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Rows with the columns of a dimension; Spark broadcasts it if its size allows."""
    return df.join(dimension, on, how)


def roots(spans: DataFrame, trace: str, span: str, parent: str) -> DataFrame:
    """Spans whose parent isn't in their trace."""
    known = spans.select(F.col(trace).alias(trace), F.col(span).alias("_id"))
    return spans.join(known, (spans[trace] == known[trace]) & (spans[parent] == known["_id"]), "left_anti")
