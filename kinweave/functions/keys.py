"""Blocking keys of prepared records, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tagged(tag: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(tag), t))


def _when(ok: Column, *keys: Column) -> Column:
    return F.when(ok, F.array(*keys)).otherwise(F.array().cast("array<string>"))


def _split(column: str) -> Column:
    """Tokens of a space-joined column; none if it is empty."""
    return F.filter(F.split(column, " "), lambda t: t != "")


def name_keys() -> Column:
    """Words (alias included), skeletons, the compact name and its beginning."""
    return F.array_distinct(
        F.concat(
            _tagged("w:", _split("name_core")),
            _tagged("k:", F.filter(_split("name_skel"), lambda t: F.length(t) >= 2)),
            _when(F.length("name_compact") >= 4, F.concat(F.lit("c:"), "name_compact"), F.concat(F.lit("p:"), F.substring("name_compact", 1, 6))),
            _tagged("w:", _split("name_alias")),
        )
    )


def addr_keys() -> Column:
    """Words, skeletons, numbers, and the first number with the first word."""
    alpha, nums = _split("addr_alpha"), _split("addr_nums")
    first = F.concat(F.lit("h:"), F.try_element_at(nums, F.lit(1)), F.lit("_"), F.try_element_at(alpha, F.lit(1)))
    return F.array_distinct(
        F.concat(
            _tagged("a:", alpha),
            _tagged("ak:", F.filter(_split("addr_skel"), lambda t: F.length(t) >= 3)),
            _tagged("n:", nums),
            _when((F.size(alpha) > 0) & (F.size(nums) > 0), first),
        )
    )


def _pairs(tag: str, tokens: Column) -> Column:
    """Every unordered pair of a sorted set."""
    ordered = F.array_sort(F.array_distinct(tokens))
    return F.flatten(
        F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.concat(F.lit(tag), a, F.lit("|"), b)))
    )


def conj_keys() -> Column:
    """Conjunctions of two tokens: address with address, name skeleton with address, skeleton with skeleton."""
    skels = F.slice(F.filter(_split("name_skel"), lambda t: F.length(t) >= 2), 1, 3)
    addr = F.slice(_split("addr_clean"), 1, 8)
    cross = F.flatten(F.transform(skels, lambda n: F.transform(addr, lambda a: F.concat(F.lit("sa:"), n, F.lit("|"), a))))
    return F.array_distinct(F.concat(_pairs("aa:", addr), cross, _pairs("nn:", skels)))


def rescue_keys() -> Column:
    """Exact blocks: compact name, sorted skeletons, sorted distinct numbers."""
    skels = F.array_join(F.array_sort(_split("name_skel")), "")
    nums = F.array_sort(F.array_distinct(_split("addr_nums")))
    digits = F.aggregate(nums, F.lit(0), lambda a, t: a + F.length(t))
    return F.concat(
        _when(F.length("name_compact") >= 5, F.concat(F.lit("c:"), "name_compact")),
        _when(F.length(skels) >= 4, F.concat(F.lit("s:"), skels)),
        _when(digits >= 4, F.concat(F.lit("n:"), F.array_join(nums, "|"))),
    )


__all__ = ["addr_keys", "conj_keys", "name_keys", "rescue_keys"]
