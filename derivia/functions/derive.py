"""Values as pure functions of (seed, key, salt).

Nothing here draws from a generator with state: a value depends on a row's stable key alone, so partitioning, retries
and speculative tasks can't change it. Everything is a Column expression of built-in functions.

Two kernels: `md5` (default; other SQL engines compute the same values) and `xxhash64` (about twice as fast).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = ("md5", "xxhash64")
_kernel: ContextVar[str] = ContextVar("kernel", default="md5")
#: Picks of so many values or fewer become a CASE expression, others look their place up in an array.
CASE_VALUES = 64
MAX_DIGITS = 18


@contextmanager
def using_kernel(name: str) -> Iterator[None]:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(KERNELS)}")
    token = _kernel.set(name)
    try:
        yield
    finally:
        _kernel.reset(token)


def hash_key(seed: int | str, salt: str) -> str:
    """Sixteen hex digits that stand for a seed and what is drawn; of fixed width, so that a key can follow directly."""
    return hashlib.sha256(f"{seed}\0{salt}".encode()).hexdigest()[:16]


def _digest(key: Column, seed: int | str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(hash_key(seed, salt)), key))


def u64(key: Column, seed: int | str, salt: str) -> Column:
    """A hash of 64 bits, as decimal(20, 0)."""
    if _kernel.get() == "xxhash64":
        h = F.xxhash64(F.lit(hash_key(seed, salt)), key).cast("decimal(20,0)")
        return F.when(h < 0, h + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)")
    return F.conv(F.substring(_digest(key, seed, salt), 1, 16), 16, 10).cast("decimal(20,0)")


def unit(key: Column, seed: int | str, salt: str) -> Column:
    """A double in [0, 1), of 52 bits, so that it never rounds to 1."""
    if _kernel.get() == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(hash_key(seed, salt)), key), 12).cast("double") / F.lit(float(1 << 52))
    return F.conv(F.substring(_digest(key, seed, salt), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def integers(key: Column, seed: int | str, salt: str, low: int, high: int) -> Column:
    """A long in [low, high)."""
    if high <= low:
        raise ValueError(f"integers need high > low, got low={low} and high={high}")
    return (u64(key, seed, salt) % F.lit(high - low).cast("decimal(20,0)")).cast("long") + F.lit(low)


def normal(key: Column, seed: int | str, salt: str, mean: float, sd: float) -> Column:
    """A normal double, from two uniform ones of the salts bm1 and bm2 (Box and Muller)."""
    one = F.greatest(unit(key, seed, f"{salt}\0bm1"), F.lit(1e-12))
    two = unit(key, seed, f"{salt}\0bm2")
    return F.lit(float(mean)) + F.lit(float(sd)) * F.sqrt(-2.0 * F.ln(one)) * F.cos(F.lit(2.0 * math.pi) * two)


def checked_weights(n: int, weights: Sequence[float]) -> list[float]:
    """Cumulative shares of weights; rejects other lengths, non-finite and negative weights and a total of nothing."""
    w = [float(x) for x in weights]
    if len(w) != n:
        raise ValueError(f"{len(w)} weights do not fit {n} values")
    for i, x in enumerate(w):
        if not math.isfinite(x):
            raise ValueError(f"weights must be finite, got {x} at index {i}")
    if min(w) < 0:
        raise ValueError("weights must not be negative")
    total = sum(w)
    if total <= 0:
        raise ValueError("weights must add up to a positive number")
    sums, out = 0.0, []
    for x in w:
        sums += x / total
        out.append(sums)
    return out


def pick_place(u: Column, n: int, weights: Sequence[float] | None = None) -> Column:
    """The place, from 0, that a uniform value picks among n: the first whose cumulative share is above it."""
    if n < 1:
        raise ValueError("a pick needs at least one value")
    if weights is None:
        return F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    sums = checked_weights(n, weights)
    if n <= CASE_VALUES:
        out = F.lit(n - 1)
        for i in range(n - 2, -1, -1):
            out = F.when(u < sums[i], i).otherwise(out)
        return out
    return F.least(F.size(F.filter(F.array(*map(F.lit, sums)), lambda c: c <= u)), F.lit(n - 1))


def pick(key: Column, seed: int | str, salt: str, values: Sequence[Any], weights: Sequence[float] | None = None, cast: str | None = None) -> Column:
    """One of the values, by weight or with equal odds."""
    place = pick_place(unit(key, seed, salt), len(values), weights)
    literals = [F.lit(v) if cast is None else F.lit(v).cast(cast) for v in values]
    return F.get(F.array(*literals), place)


def derive_id(key: Column, seed: int | str, tag: str, *, prefix: str = "", digits: int = 10) -> Column:
    """An identifier: prefix and zero-padded digits of the key's hash. The same key, seed and tag give the same one anywhere."""
    if not 1 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must be from 1 to {MAX_DIGITS}, got {digits}")
    number = (u64(key, seed, f"id\0{tag}") % F.lit(10**digits).cast("decimal(20,0)")).cast("long").cast("string")
    return F.concat(F.lit(prefix), F.lpad(number, digits, "0"))
