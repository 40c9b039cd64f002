"""Version order and the version that an advisory stands for, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What versions are cut at, and marks of those before a release.
CUTS = r"[.\-+_]"
EARLY = r"(?i)(alpha|beta|rc|snapshot|dev)"


def version_key(version: Column) -> Column:
    """An array that orders like the version: parts in turn, numbers before texts and by value, texts by their characters, fewer parts first.

    A number is its count of digits and then the digits, so it may be of any length.
    """
    digits = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")

    def key(part: Column) -> Column:
        number = part.rlike(r"^[0-9]+$")
        return F.struct(
            F.when(number, 0).otherwise(1).alias("kind"), F.when(number, F.length(digits(part))).otherwise(0).alias("size"), F.when(number, digits(part)).otherwise(part).alias("text"),
        )

    return F.transform(F.split(version, CUTS, -1), key)


def highest_version(versions: Column) -> Column:
    """The last in version order of those that are no pre-release; of equal ones the last given. Null of none."""
    final = F.filter(versions, lambda v: (F.length(v) > 0) & ~v.rlike(EARLY))
    return F.array_max(F.transform(final, lambda v, i: F.struct(version_key(v).alias("key"), i.alias("i"), v.alias("version"))))["version"]


def affected_version(affected: Column) -> Column:
    """The highest version listed as affected, else the first bound other than 0 at which a range is introduced.

    affected: struct<versions: array<string>, ranges: array<struct<events: array<struct<introduced: string>>>>>.
    """
    events = F.flatten(F.transform(affected["ranges"], lambda r: F.coalesce(r["events"], F.array().cast("array<struct<introduced:string>>"))))
    bound = F.filter(F.transform(events, lambda e: e["introduced"]), lambda v: (F.length(v) > 0) & (v != "0"))
    return F.coalesce(highest_version(affected["versions"]), F.get(bound, F.lit(0)))
