"""Seeded draws: uniform numbers from MD5 sums of seed, name and id, alike on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "s42"


def draw(name: str, ident: Column, seed: str = SEED) -> Column:
    """A whole number in 0 .. 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), ident.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(name: str, ident: Column, seed: str = SEED) -> Column:
    """In [0, 1)."""
    return draw(name, ident, seed) / float(1 << 32)


def choice(name: str, ident: Column, options: Column, seed: str = SEED) -> Column:
    return F.element_at(options, (draw(name, ident, seed) % F.size(options) + 1).cast("int"))


def bernoulli(name: str, ident: Column, p: float, seed: str = SEED) -> Column:
    return uniform(name, ident, seed) < p


def log_uniform(name: str, ident: Column, low: float, high: float, seed: str = SEED) -> Column:
    return F.exp(F.log(F.lit(low)) + uniform(name, ident, seed) * (F.log(F.lit(high)) - F.log(F.lit(low))))


def forced(flag: Column, p: float) -> Column:
    """The chance of an event that a flag forces (true) or forbids (false); p where it is null."""
    return F.coalesce(flag.cast("double"), F.lit(p))


def bernoulli_of(name: str, ident: Column, chance: Column, seed: str = SEED) -> Column:
    """bernoulli with a chance of each row's own: 1 always happens, 0 never."""
    return uniform(name, ident, seed) < chance
