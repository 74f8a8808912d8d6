"""Attribute sets as bit masks: bit i stands for attribute i. Python integers on the driver, BIGINT columns in plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(n: int) -> int:
    return (1 << n) - 1


def of(attributes: Iterable[int], n: int | None = None) -> int:
    """The mask of a list of attributes; with n, each has to be below it."""
    mask = 0
    for i in attributes:
        if i < 0 or (n is not None and i >= n):
            raise ValueError(f"attribute {i} is not in 0..{n}")
        mask |= 1 << i
    return mask


def members(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def span(start: int, end: int) -> int:
    """Attributes from start to end, end exclusive."""
    return (1 << end) - (1 << start) if end > start else 0


def next_set(mask: int, start: int) -> int:
    """The first attribute from start on that is in the mask, or -1."""
    rest = mask >> start
    return start + (rest & -rest).bit_length() - 1 if rest else -1


def next_unset(mask: int, start: int) -> int:
    return next_set(~mask & full(max(mask.bit_length(), start) + 1), start)


def without_nth(mask: int, k: int) -> int:
    """The mask without its k-th attribute, counted from 1."""
    return mask & ~(1 << members(mask)[k - 1])


def subsets(mask: int) -> Iterator[int]:
    """All subsets, ascending."""
    s = 0
    while True:
        yield s
        if s == mask:
            return
        s = (s - mask) & mask


def deposit(value: int, mask: int) -> int:
    """Bit j of value goes to the j-th attribute of the mask."""
    return sum(1 << i for j, i in enumerate(members(mask)) if value >> j & 1)


def text(mask: int) -> str:
    return "{" + ", ".join(map(str, members(mask))) + "}"


def bit_string(mask: int, n: int) -> str:
    """A digit for each attribute, attribute 0 first."""
    return "".join(str(mask >> i & 1) for i in range(n))


def parse(s: str) -> int:
    """The mask of a text such as {0, 3} or 0,3; blanks don't count."""
    inner = s.strip().removeprefix("{").removesuffix("}").strip()
    return of(int(x) for x in inner.split(",")) if inner else 0


# ---- columns ---------------------------------------------------------------------------------------------------------


def _long(m) -> Column:
    return m.cast("bigint") if isinstance(m, Column) else F.lit(m).cast("bigint")


def bit(i) -> Column:
    return F.call_function("shiftleft", _long(1), i.cast("int") if isinstance(i, Column) else F.lit(i))


def c_add(m: Column, i) -> Column:
    return m.bitwiseOR(bit(i))


def c_remove(m: Column, i) -> Column:
    return m.bitwiseAND(F.bitwise_not(bit(i)))


def c_flip(m: Column, i) -> Column:
    return m.bitwiseXOR(bit(i))


def c_has(m: Column, i) -> Column:
    return m.bitwiseAND(bit(i)) != 0


def c_union(a, b) -> Column:
    return _long(a).bitwiseOR(_long(b))


def c_both(a, b) -> Column:
    return _long(a).bitwiseAND(_long(b))


def c_minus(a, b) -> Column:
    return _long(a).bitwiseAND(F.bitwise_not(_long(b)))


def c_complement(m: Column, n: int) -> Column:
    return m.bitwiseXOR(_long(full(n)))


def c_meets(a, b) -> Column:
    return c_both(a, b) != 0


def c_covers(a, b) -> Column:
    """a is a superset of b."""
    return c_both(a, b) == _long(b)


def c_size(m: Column) -> Column:
    return F.bit_count(m)


def c_members(m: Column, n: int) -> Column:
    """The attributes as an ascending array<int>."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: c_has(m, i))


def c_of(attributes: Column) -> Column:
    """The mask of an array of attributes."""
    return F.aggregate(attributes, _long(0), lambda a, i: a.bitwiseOR(bit(i)))


def c_text(m: Column, n: int) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(c_members(m, n), lambda i: i.cast("string")), ", "), F.lit("}"))


def c_bit_string(m: Column, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(c_has(m, i), "1").otherwise("0")), "")
