"""Tile, point and change identifiers, and small text rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilescope.config import DECISION_DISPLAY, POINT_NAMESPACE, STATUS_WORDS


def tile_identity(stem: Column, row: Column, col: Column, date: Column) -> Column:
    return F.concat(stem, F.lit("_r"), row.cast("string"), F.lit("_c"), col.cast("string"), F.lit("_"), date)


def point_id(tile_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based (version 5) UUID of a tile id; a random one where the id is missing or empty."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(tile_id, "UTF-8")))
    # Version 5 replaces the 13th digit; the 17th keeps its low two bits under binary 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    layout = r"^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$"
    named = F.regexp_replace(digest, F.lit(layout), F.concat(F.lit("$1-$2-5$3-"), variant, F.lit("$4-$5")))
    return F.when(tile_id.isNull() | (tile_id == ""), F.uuid()).otherwise(named)


def id_aliases(change_id: Column) -> Column:
    """Ids to try for a tile or change id, best first: second half, first half, whole."""
    parts = F.split(change_id, "__", 2)
    return F.when(change_id.contains("__"), F.array(parts[1], parts[0], change_id)).otherwise(F.array(change_id))


def id_halves(change_id: Column) -> Column:
    return F.split(change_id, "__")


def split_change_id(change_id: Column, date_first: str, date_last: str) -> Column:
    """struct(t1, t2). A single id is completed by swapping its date text."""
    parts = F.split(change_id, "__", 2)
    whole = F.struct(parts[0].alias("t1"), parts[1].alias("t2"))
    from_first = F.struct(
        change_id.alias("t1"), F.replace(change_id, F.lit(date_first), F.lit(date_last)).alias("t2")
    )
    from_last = F.struct(
        F.replace(change_id, F.lit(date_last), F.lit(date_first)).alias("t1"), change_id.alias("t2")
    )
    return (
        F.when(change_id.contains("__"), whole)
        .when(change_id.contains(date_first), from_first)
        .otherwise(from_last)
    )


def grid_position(tile_id: Column, default: int = 256) -> tuple[Column, Column]:
    """Pixel row and column written in a tile id."""

    def part(group: int) -> Column:
        text = F.regexp_extract(tile_id, r"_r(\d+)_c(\d+)", group)
        return F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(default))

    return part(1), part(2)


def first_truthy(*values: Column | str) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(F.col(v) if isinstance(v, str) else v, F.lit("")) for v in values])


def first_nonzero(*values: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(v, F.lit(0).cast("double")) for v in values])


def normalise_status(status: Column) -> Column:
    word = F.lower(status)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in STATUS_WORDS.items():
        rule = rule.when(word.isin(words), F.lit(name))
    return rule.otherwise(F.lit("PENDING"))


def decision_display(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(DECISION_DISPLAY.items())])
    return F.coalesce(F.try_element_at(table, F.upper(status)), F.lower(status))


def safe_name(text: Column, length: int | None = None) -> Column:
    clean = F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_")
    return F.substring(clean, 1, length) if length else clean


def clamp_confidence(value: Column) -> Column:
    """Number within [0, 1]; 0 for anything that is not a number."""
    number = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def confidence_band(value: Column) -> Column:
    return F.when(value > 0.7, F.lit("high")).when(value >= 0.35, F.lit("medium")).otherwise(F.lit("low"))


def day_of(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def date_features(first: Column, second: Column) -> tuple[Column, Column, Column]:
    """Days between two date texts and their months; 30 / 1 / 1 where unreadable."""
    a, b = day_of(first), day_of(second)
    return (
        F.coalesce(F.abs(F.datediff(b, a)), F.lit(30)),
        F.coalesce(F.month(a), F.lit(1)),
        F.coalesce(F.month(b), F.lit(1)),
    )
