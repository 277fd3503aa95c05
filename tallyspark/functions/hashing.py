"""Hashes that stand in for random draws: the same row always gets the same number, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rank_key(*parts: Column | str) -> Column:
    """The sha256 by which samples are ranked."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def digest_mod(text: Column, n: int) -> Column:
    """The sha256 of a text as one number, modulo n."""
    digits = F.split(F.sha2(text.cast("binary"), 256), "")
    value = lambda c: F.conv(c, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0), lambda a, c: (a * 16 + value(c)) % n)


def split_name(state: Column, seed: str, holdout: float, val: float = 0.1) -> Column:
    """holdout, val or train by two prefixes of the sha1 of seed and state."""
    digest = F.sha1(F.concat(F.lit(seed + "|"), state).cast("binary"))
    part = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.when(part(1) < holdout, "holdout").when(part(9) < val, "val").otherwise("train")
