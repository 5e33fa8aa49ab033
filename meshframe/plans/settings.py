"""Settings by name, as text: what the engine takes from an environment or a configuration file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from meshframe.errors import InvalidArgument
from meshframe.plans.selection import Choice, parse

_BOOL = {"0": False, "1": True, "false": False, "true": True}


@dataclass(frozen=True)
class Settings:
    """fusion (planned.calls), its limits and whether urgent calls flush it; priority mode and whether calls are waited for
    (runtime.start); elements of a packed chunk; bfloat16 rounding; strategy hints for each collective."""

    fusion: bool = False
    fusion_bytes_threshold: int = 16384
    fusion_count_threshold: int = 256
    fusion_check_urgent: bool = True
    priority: str = "none"
    op_sync: bool = False
    chunk_elements: int = 1024
    bf16: str = "truncate"
    allreduce: str = ""
    reduce: str = ""
    reduce_scatter: str = ""
    allgather: str = ""
    allgatherv: str = ""
    alltoall: str = ""
    alltoallv: str = ""
    broadcast: str = ""

    _choices = {"priority": ("none", "direct", "lifo"), "bf16": ("truncate", "rne")}

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "MESHFRAME_") -> Settings:
        """From a mapping such as os.environ; unknown names with the prefix are errors."""
        known = {f.name: f for f in fields(cls)}
        found = {}
        for key, text in values.items():
            if not key.startswith(prefix):
                continue
            name = key[len(prefix) :].lower()
            if name not in known:
                raise InvalidArgument(f"unknown setting {key}")
            default = known[name].default
            try:
                value = _BOOL[text.lower()] if isinstance(default, bool) else int(text) if isinstance(default, int) else text
            except (KeyError, ValueError):
                raise InvalidArgument(f"{key}: not a value: {text}") from None
            if name in cls._choices and value not in cls._choices[name]:
                raise InvalidArgument(f"{key}: not one of {', '.join(cls._choices[name])}")
            found[name] = value
        settings = cls(**found)
        for name in ("allreduce", "reduce", "reduce_scatter"):
            settings.hints(name)
        for name in ("allgather", "allgatherv", "alltoall", "alltoallv", "broadcast"):
            if any(c.strategy != "long" for c in settings.hints(name)):
                raise InvalidArgument(f"{name} moves elements, a row each: it has no other strategy than long")
        return settings

    def hints(self, collective: str) -> list[Choice]:
        return parse(getattr(self, collective))
