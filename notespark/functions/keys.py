"""Dotted hierarchical keys: order, containment, ancestors, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLIDES_OFFSET = 10_000
EXTRA_OFFSET = 20_000


def sort_key(key: Column) -> Column:
    """``3.1.2`` -> [3,1,2]; ``S1`` sorts after all chapters, ``Z1`` after all slides."""
    def part(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^[SZ]?(\d+)$", 1).try_cast("int")
        offset = F.when(p.startswith("S"), SLIDES_OFFSET).when(p.startswith("Z"), EXTRA_OFFSET).otherwise(0)
        return F.coalesce(digits + offset, F.lit(0))

    return F.transform(F.split(key, r"\."), part)


def covers(selected: Column, key: Column) -> Column:
    return (key == selected) | key.startswith(F.concat(selected, F.lit(".")))


def ancestors(key: Column) -> Column:
    """``3.1.2`` -> [3, 3.1, 3.1.2]: turns a prefix join into an equi join."""
    return F.transform(
        F.sequence(F.lit(1), F.size(F.split(key, r"\."))),
        lambda depth: F.array_join(
            F.slice(F.split(key, r"\."), F.lit(1), depth), "."),
    )


def parent(key: Column) -> Column:
    return F.when(key.contains("."), F.regexp_replace(key, r"\.[^.]*$", ""))


def root(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def num_prefix(number: Column) -> Column:
    """``2.2.6`` -> ``2.2``; NULL for a number of one part."""
    return F.when(number.contains("."), F.regexp_replace(number, r"\.[^.]*$", ""))


def last_part(number: Column) -> Column:
    return F.element_at(F.split(number, r"\."), -1).cast("int")


def is_slides(key: Column) -> Column:
    return F.coalesce(key.startswith("S"), F.lit(False))


def is_extra(key: Column) -> Column:
    return F.coalesce(key.startswith("Z"), F.lit(False))


def switched_off(key: Column, slides_on: Column, extra_on: Column) -> Column:
    return (is_extra(key) & ~extra_on) | (is_slides(key) & ~slides_on)


def section_label(key: Column, title: Column, root_title: Column) -> Column:
    """How a section is shown: number and title, a slide deck's part by deck and title, a
    section of another script by script name and inner number."""
    inner = F.regexp_replace(key, r"^[^.]*\.", "")
    nested = key.contains(".")
    inner_label = F.when(title.isNotNull(), F.concat_ws(" ", inner, title)).otherwise(inner)
    extra = (
        F.when(~nested, F.coalesce(title, key))
        .when(root_title.isNotNull(), F.concat_ws(" · ", root_title, inner_label))
        .otherwise(inner_label)
    )
    slides = F.when(
        nested & root_title.isNotNull(), F.concat_ws(" · ", root_title, F.coalesce(title, key))
    ).otherwise(F.coalesce(title, key))
    plain = F.when(title.isNotNull(), F.concat_ws(" ", key, title)).otherwise(key)
    return F.when(is_extra(key), extra).when(is_slides(key), slides).otherwise(plain)
