"""Ordered, paged listings."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE, ADMIN_PAGE_SIZE = 20, 100
QUEUE = 10_000  # rows that a task may queue to find a page; deeper pages are looked for by ranges
RANGES, SAMPLED = 32, 2048  # ranges counted at a time, and about as many rows are sampled to choose them


class NotFound(LookupError):
    """No such page or row."""


class NotUnique(LookupError):
    """More than one row where one was asked for."""


def terms(spec: str | None, allowed: list[str], default: str, key: str = "id") -> list[tuple[str, bool]]:
    """(name, descending) of a comma list of names, - for descending; unknown names are dropped, none left means the default.

    The key comes last, to break ties.
    """
    names = [t.strip() for t in (spec or "").split(",")]
    kept = [t for t in names if t.removeprefix("-") in allowed] or [default]
    out = [(t.removeprefix("-"), t.startswith("-")) for t in kept]
    return out if any(n == key for n, _ in out) else [*out, (key, False)]


def sorting(by: list[tuple[str, bool]], backwards: bool = False) -> list[Column]:
    """Sort columns; nulls come last ascending and first descending, as if they were larger than all else."""
    return [F.col(n).desc_nulls_first() if down != backwards else F.col(n).asc_nulls_last() for n, down in by]


def order(spec: str | None, allowed: list[str], default: str, key: str = "id") -> list[Column]:
    return sorting(terms(spec, allowed, default, key))


def page(df: DataFrame, by: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` (from 1) without a look at the bounds; the plan takes the top rows of each task.

    Each task's queue holds all rows up to the page's end; for pages far from both ends see `page_at` and `following`.
    """
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


def _behind(by: list[tuple[str, bool]], last: dict) -> Column:
    """Whether a row comes behind the one whose values are `last`."""
    later, same = F.lit(False), F.lit(True)
    for name, down in by:
        c, v = F.col(name), last[name]
        if v is None:
            here = c.isNotNull() if down else F.lit(False)
        else:
            here = c < F.lit(v) if down else (c > F.lit(v)) | c.isNull()
        later = later | (same & F.coalesce(here, F.lit(False)))
        same = same & (c.isNull() if v is None else F.coalesce(c == F.lit(v), F.lit(False)))
    return later


def page_at(df: DataFrame, by: list[tuple[str, bool]], offset: int, count: int, size: int = PAGE_SIZE, queue: int = QUEUE) -> DataFrame:
    """`size` rows from `offset` on of the `count` rows of `df` in the order `by`, which is of `terms`.

    While more than `queue` rows may lie before the page, the order is cut into ranges at sampled rows, one pass counts the
    rows behind each cut, and only the range that holds the page's first row is looked at further, with what the page
    needs of the next. Then the rest is a top-k. A pass moves one row of counts for each task; samples are bounded, and
    as counts are exact, so is the page, whatever was sampled. Rows that share all of `by` cannot be told apart by cuts.
    """
    names, low, high = [n for n, _ in by], None, None  # cuts before and behind what is looked at
    skipped, rows = 0, count
    while min(offset - skipped, rows) > queue:
        part = df if low is None else df.where(_behind(by, low))
        part = part if high is None else part.where(~_behind(by, high))
        seen = part.select(*names).sample(min(1.0, SAMPLED / rows), seed=skipped + rows).limit(4 * SAMPLED).distinct().collect()
        cuts = [r.asDict() for r in sorted(seen, key=lambda r: [_place(r[n], down) for n, down in by])]
        cuts = cuts[:: max(1, len(cuts) // RANGES)]
        if not cuts:
            break
        behind = part.agg(*[F.count_if(_behind(by, c)).alias(f"n{i}") for i, c in enumerate(cuts)]).first()
        upto = [skipped + rows - n for n in behind]  # rows of the listing up to each cut
        before = [i for i, n in enumerate(upto) if n <= offset]
        enough = [i for i, n in enumerate(upto) if n >= offset + size]
        was = skipped, rows
        if before:
            low, skipped = cuts[before[-1]], upto[before[-1]]
        rows = was[0] + was[1] - skipped
        if enough:
            high, rows = cuts[enough[0]], upto[enough[0]] - skipped
        if (skipped, rows) == was:
            break
    part = df if low is None else df.where(_behind(by, low))
    part = part if high is None else part.where(~_behind(by, high))
    return part.orderBy(*sorting(by)).offset(offset - skipped).limit(size)


class _Downwards:
    """A value that sorts the other way round."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return other.value < self.value

    def __eq__(self, other) -> bool:
        return self.value == other.value


def _place(value, down: bool) -> tuple:
    """A sort key with nulls where `sorting` puts them."""
    if value is None:
        return (0 if down else 2,)
    return 1, _Downwards(value) if down else value


def following(df: DataFrame, by: list[tuple[str, bool]], last: dict, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind a row whose values are `last`: a filter and a top-k of one page, however deep it lies."""
    return df.where(_behind(by, last)).orderBy(*sorting(by)).limit(size)


@dataclass(frozen=True)
class Page:
    """A page with its envelope."""

    count: int
    number: int
    pages: int
    results: DataFrame

    @property
    def next(self) -> int | None:
        return self.number + 1 if self.number < self.pages else None

    @property
    def previous(self) -> int | None:
        return self.number - 1 if self.number > 1 else None


def paginate(df: DataFrame, by: list[tuple[str, bool]] | list[Column], number: int | str = 1, size: int = PAGE_SIZE) -> Page:
    """The page asked for, or NotFound. "last" is the last page; an empty listing has one page.

    Where `by` is from `terms`, a page nearer to the end is taken from there: the first rows of the reversed order, turned;
    and a page with more than QUEUE rows on both sides is looked for by ranges.
    """
    count = df.count()
    pages = max(1, -(-count // size))
    if number == "last":
        number = pages
    try:
        number = int(number)
    except ValueError:
        raise NotFound(f"no page {number}") from None
    if not 1 <= number <= pages:
        raise NotFound(f"no page {number}")
    if not isinstance(by[0], tuple):
        rows = page(df, by, number, size)
    elif min(number - 1, pages - number) * size > QUEUE:
        rows = page_at(df, by, (number - 1) * size, count, size)
    elif 2 * number <= pages:
        rows = page(df, sorting(by), number, size)
    else:
        behind = max(0, count - number * size)
        rows = df.orderBy(*sorting(by, True)).offset(behind).limit(count - behind - (number - 1) * size).orderBy(*sorting(by))
    return Page(count, number, pages, rows)


def envelope(df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One row: count, pages, next, previous of page `number`, as a query."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("count")).withColumn("pages", pages)
    return row.select(
        "count", "pages", F.when(F.col("pages") > number, F.lit(number + 1)).alias("next"), F.lit(number - 1 if number > 1 else None).cast("int").alias("previous")
    )


def single(df: DataFrame):
    """The only row, or NotFound or NotUnique."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise NotUnique("more than one row") if rows else NotFound("no row")
    return rows[0]


def first_match(df: DataFrame, *conditions: Column, key: str = "id") -> DataFrame:
    """Rows that meet the first of the conditions that any row meets; none if no row meets any."""
    rank = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])
    ranked = df.withColumn("_rank", rank).where("_rank is not null")
    best = ranked.agg(F.min("_rank").alias("_best"))  # one row
    return ranked.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")
