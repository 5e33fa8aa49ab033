"""Strategy hints by message size.

Grammar: `<strategy>` or `<strategy>:<left>-<right>` joined by `;`, sizes in bytes, `max` for no limit. Later entries
win where ranges overlap. Strategies change how a call is planned, not its result: long (an element a row), packed
(arrays of elements), tree (nodes first, then across them). planned_allreduce() plans by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from meshframe.errors import InvalidArgument

STRATEGIES = ("long", "packed", "tree")
MAX = 1 << 63


@dataclass(frozen=True)
class Choice:
    strategy: str
    left: int
    right: int


def parse(text: str) -> list[Choice]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, span = part.partition(":")
        if name not in STRATEGIES:
            raise InvalidArgument(f"unknown strategy {name}")
        left, right = 0, MAX
        if span:
            low, dash, high = span.partition("-")
            if not dash or not low.isdigit() or not (high.isdigit() or high == "max"):
                raise InvalidArgument(f"not a range of sizes: {span}")
            left, right = int(low), MAX if high == "max" else int(high)
            if right < left:
                raise InvalidArgument(f"an empty range: {span}")
        out.append(Choice(name, left, right))
    return out


def choose(hints: list[Choice], size: int, default: str = "long") -> str:
    """The last hint whose range holds the size."""
    for c in reversed(hints):
        if c.left <= size <= c.right:
            return c.strategy
    return default
