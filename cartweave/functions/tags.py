"""Functions of tag maps. Keys are unique and values never null, which every function here keeps up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,string>)"


def has_tag(tags: Column, key: str) -> Column:
    return F.map_contains_key(tags, F.lit(key))


def tag_equals(tags: Column, key: str, value: str) -> Column:
    """A missing key equals nothing."""
    return F.coalesce(tags[F.lit(key)] == F.lit(value), F.lit(False))


def set_tag(tags: Column, key: str, value: str) -> Column:
    return F.map_concat(F.map_filter(tags, lambda k, _: k != F.lit(key)), F.create_map(F.lit(key), F.lit(value)))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    """The value of ``old`` goes to ``new``, over what is there; without ``old`` nothing changes."""
    if old == new:
        return tags
    rest = F.map_filter(tags, lambda k, _: ~k.isin(old, new))
    return F.when(has_tag(tags, old), F.map_concat(rest, F.create_map(F.lit(new), tags[F.lit(old)]))).otherwise(tags)


def keep_tags(tags: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(tags, lambda k, _: k.isin(*keys))


def delete_tags(tags: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys))


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value) structs in which the last of equal keys counts; null keys and values are left out.

    Independent of how the session treats duplicate keys. With all keys distinct, which is nearly always, nothing is searched.
    """
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    keys = F.transform(entries, lambda e: e["key"])
    unique = F.filter(entries, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)
    chosen = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(unique)
    return F.coalesce(F.map_from_entries(chosen), F.expr(EMPTY))
