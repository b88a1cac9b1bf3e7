"""Views: named choices of the slots of a vector. Choices are made on the driver, in plan order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.seeds import drawn


@dataclass(frozen=True)
class View:
    name: str
    mode: str = "all"
    indices: list[int] = field(default_factory=list)
    fraction: float = 0.5
    of: str | None = None
    seed_offset: int = 0


def view_seed(seed: int, name: str, offset: int = 0) -> int:
    return (seed ^ int(hashlib.sha256(name.encode()).hexdigest()[:8], 16) ^ offset) & 0xFFFFFFFF


def resolve(views: list[View], width: int, seed: int) -> dict[str, list[int]]:
    """Sorted slots by view."""
    if len({v.name for v in views}) != len(views) or len(views) < 2:
        raise ValueError("two views at least, each with a name of its own")
    out: dict[str, list[int]] = {}
    for v in views:
        if v.mode == "all":
            got = list(range(width))
        elif v.mode == "indices":
            got = sorted(v.indices)
            if len(set(got)) != len(got) or not got or got[0] < 0 or got[-1] >= width:
                raise ValueError(f"bad indices of view {v.name}")
        elif v.mode == "random":
            k = min(max(round(v.fraction * width), 1), width)
            own = view_seed(seed, v.name, v.seed_offset)
            got = sorted(sorted(range(width), key=lambda i: (drawn(own, "view", i), i))[:k])
        elif v.mode == "complement":
            if v.of not in out:
                raise ValueError(f"view {v.name} refers to a later view, or to none")
            got = sorted(set(range(width)) - set(out[v.of]))
            if not got:
                raise ValueError(f"view {v.name} is empty")
        else:
            raise ValueError(f"unknown mode {v.mode!r}")
        out[v.name] = got
    return out


def two_views(fraction: float = 0.5) -> list[View]:
    return [View("view_a", "random", fraction=fraction), View("view_b", "complement", of="view_a")]


def with_views(df: DataFrame, chosen: dict[str, list[int]], x: str = "x") -> DataFrame:
    """A column for each view; labels, masks and all else stay."""
    return df.withColumns({name: F.array(*[F.col(x)[i] for i in slots]) for name, slots in chosen.items()})
