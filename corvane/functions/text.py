"""Column functions on text and lists, with the semantics of the web client and server that the board replaces."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what the client's trim strips.
WHITE = r"[\s\p{Z}\x{FEFF}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jstrim(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind; Spark's trim strips spaces only."""
    return F.regexp_replace(_col(c), f"^{WHITE}|{WHITE}$", "")


def split_list(c: Column | str) -> Column:
    """Items of a comma list: trimmed, empty ones dropped, repeats kept; null and empty give an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), jstrim), lambda x: x != "")


def join_list(items: Column | str) -> Column:
    """A comma list of the items that are not blank."""
    return F.array_join(F.filter(F.transform(_col(items), jstrim), lambda x: x != ""), ", ")


def join_classes(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def first_truthy(*cols: Column | str) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def js_round(c: Column | str) -> Column:
    """To whole numbers, halves upwards."""
    return F.floor(_col(c) + F.lit(0.5)).cast("long")


def rounded_mean(total: Column, n: Column) -> Column:
    """js_round(total / n); null for no rows."""
    return js_round(F.try_divide(total.cast("double"), n))


def to_number(c: Column | str) -> Column:
    """An integer; null for empty or unreadable text."""
    return F.nullif(jstrim(c), F.lit("")).try_cast("int")


def contains_text(c: Column | str, part: Column | str) -> Column:
    """Whether `part` is in `c`, whatever the case; null counts as absent. `part` is literal text, not a pattern."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(F.contains(F.lower(_col(c)), F.lower(part)), F.lit(False))


def any_contains(items: Column | str, part: str) -> Column:
    return F.coalesce(F.exists(_col(items), lambda x: contains_text(x, part)), F.lit(False))


def url64_encode(c: Column | str) -> Column:
    """URL-safe base64 of the text of `c`, without padding."""
    return F.regexp_replace(F.translate(F.base64(_col(c).cast("string").cast("binary")), "+/", "-_"), "=", "")


def url64_decode(c: Column | str) -> Column:
    """The text behind URL-safe base64, padded or not; null where it cannot be read."""
    return F.try_to_binary(F.translate(_col(c), "-_", "+/"), F.lit("base64")).cast("string")


def token_payload(token: Column | str, schema: str) -> Column:
    """The second part of a token as a struct; null fields where it cannot be read."""
    return F.from_json(url64_decode(F.split_part(_col(token), F.lit("."), F.lit(2))), schema)


def token_expiry(token: Column | str) -> Column:
    return token_payload(token, "exp long").getField("exp")


def in_tunis(ts: Column | str) -> Column:
    """A UTC time as local time in Africa/Tunis."""
    return F.from_utc_timestamp(_col(ts), "Africa/Tunis")


def message_of(body: Column | str, *fields: str) -> Column:
    """The first error text that a JSON body has in `fields`."""
    return F.coalesce(*[F.get_json_object(_col(body), f"$.{f}") for f in fields])


def lookup(key: Column | str, table: dict[str, str], default: str) -> Column:
    """The label of a code, or the default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(key)), F.lit(default))


def toggled(items: Column, x: Column) -> Column:
    """Set membership flipped: removed if present, appended if not."""
    return F.when(F.array_contains(items, x), F.array_remove(items, x)).otherwise(F.array_append(items, x))


def added(items: Column, x: Column) -> Column:
    """The trimmed item appended unless it is empty or present; case counts."""
    x = jstrim(x)
    return F.when((x != "") & ~F.array_contains(items, x), F.array_append(items, x)).otherwise(items)


def removed(items: Column, x: Column) -> Column:
    """Without any occurrence of the item."""
    return F.array_remove(items, x)
