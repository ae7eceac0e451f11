"""Column-name algebra of pipeline nodes."""

from __future__ import annotations


def out_prefix(in_prefix: str | list[str], out: str | None) -> str:
    """The output prefix: none repeats the (first) input prefix, ``x+`` puts x before it, ``+x`` after it."""
    first = in_prefix if isinstance(in_prefix, str) else in_prefix[0]
    if out is None:
        return first
    if out.endswith("+"):
        return out[:-1] + first
    if out.startswith("+"):
        return first + out[1:]
    return out
