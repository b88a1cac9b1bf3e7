"""Seeds derived on the driver, and randomness that depends on (seed, salt, id) alone, whatever the partitioning."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first32(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def part_seed(seed: int, label: str) -> int:
    """Of a named part of a sampling run."""
    return _first32(f"{int(seed)}:{label}")


def step_seed(seed: int, index: int, step: str) -> int:
    """Of a step of a preprocessing plan."""
    return _first32(f"{seed}|{index}|{step}")


def mixed_seed(seed: int, salt: int) -> int:
    """Of an item: the splitmix64 finalizer, low 32 bits."""
    mask = 2**64 - 1
    x = (int(seed) + int(salt) + 0x9E3779B97F4A7C15) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * factor) & mask
    return x & 0xFFFFFFFF


def fingerprint(spec) -> str:
    """SHA-256 of the canonical JSON of a specification."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def ticket(seed: int, salt: str, *parts) -> Column:
    """A hex string to sort by instead of a permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def uniform(seed: int, salt: str, *parts) -> Column:
    """In [0, 1)."""
    return F.conv(F.substring(ticket(seed, salt, *parts), 1, 8), 16, 10).cast("double") / float(2**32)


def drawn(seed: int, salt: str, *parts) -> float:
    """The driver's twin of uniform, for values that are no columns."""
    return int(hashlib.md5("|".join(map(str, (seed, salt, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def normal(seed: int, salt: str, *parts) -> Column:
    """N(0, 1), by Box and Muller from two tickets."""
    u, v = uniform(seed, salt + "/r", *parts), uniform(seed, salt + "/a", *parts)
    return F.sqrt(-2 * F.log(u + 2.0**-33)) * F.cos(2 * math.pi * v)


def sql_ticket(seed: int, salt: str, *parts: str) -> str:
    """The SQL twin of ticket."""
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", f"'{salt}'", *[f"CAST({p} AS VARCHAR)" for p in parts]]) + "))"


def sql_uniform(seed: int, salt: str, *parts: str) -> str:
    return f"(CAST('0x' || substr({sql_ticket(seed, salt, *parts)}, 1, 8) AS BIGINT) / 4294967296.0)"
