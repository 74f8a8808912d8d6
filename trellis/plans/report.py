"""Results as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from ..functions import bits
from ..operators.measures import JD


def names_of(mask: int, names: Sequence[str] | None) -> str:
    return bits.text(mask) if names is None else "{" + ", ".join(names[i] for i in bits.members(mask)) + "}"


def runtime(metrics: Mapping[str, object]) -> str:
    """A line for each metric."""
    width = max(map(len, metrics), default=0)
    return "\n".join(f"{k:<{width}}  {v:.6g}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in metrics.items())


def dependencies(deps: Iterable[tuple[int, int, float]], arrow: str = "->>", names: Sequence[str] | None = None) -> str:
    """A line for each (lhs, rhs, measure)."""
    return "\n".join(f"{names_of(x, names)} {arrow} {names_of(y, names)}  {m:.6f}" for x, y, m in deps)


def join_dependencies(jds: Iterable[JD], names: Sequence[str] | None = None) -> str:
    return "\n".join(f"{names_of(d.lhs, names)} | {' '.join(names_of(c, names) for c in d.components)}  {d.measure:.6f}" for d in jds)


def lattice_levels(rows: Iterable[tuple[int, int, int]], arrow: str = "->", names: Sequence[str] | None = None) -> str:
    """A line for each level of (level, lhs, rhs) rows."""
    levels: dict[int, list[str]] = {}
    for level, lhs, rhs in sorted(rows):
        levels.setdefault(level, []).append(f"{names_of(lhs, names)} {arrow} {names_of(rhs, names)}")
    return "\n".join(f"{level}: {'  '.join(x)}" for level, x in levels.items())
