"""Nodes composed into a plan: each maps a DataFrame to a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.names import out_prefix

Node = Callable[[DataFrame], DataFrame]


class PrefixNode:
    """A node that reads ``{in}name`` and writes ``{out}name``; subclasses implement ``apply``."""

    def __init__(self, in_prefix: str | list[str] = "", out: str | None = None):
        self.ins = [in_prefix] if isinstance(in_prefix, str) else list(in_prefix)
        self.out = out_prefix(in_prefix, out)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class Pipeline:
    """Nodes in order; indexable.  Nodes marked ``per_image`` run before any ``replicates`` node when
    :meth:`plan` hoists them, so work common to all views is done once."""

    def __init__(self, nodes: list[Node]):
        self.nodes = list(nodes)

    def __len__(self) -> int:
        return len(self.nodes)

    def __getitem__(self, i: int) -> Node:
        return self.nodes[i]

    def plan(self) -> list[Node]:
        cut = next((i for i, n in enumerate(self.nodes) if getattr(n, "replicates", False)), len(self.nodes))
        moved = [n for n in self.nodes[cut:] if getattr(n, "per_image", False)]
        return self.nodes[:cut] + moved + [n for n in self.nodes[cut:] if n not in moved]

    def __call__(self, df: DataFrame, timing: bool = False) -> DataFrame:
        """Fold the plan over the frame.  ``timing`` prints the seconds each node takes to plan;
        execution is lazy and timed by Spark itself."""
        for node in self.plan():
            began = time.time()
            df = node(df)
            if timing:
                print(f"{getattr(node, '__name__', type(node).__name__)}: {time.time() - began:.3f} s")
        return df


Compose = Pipeline
