"""Strategies by the texts that configurations name them by, and a typed configuration."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators import allocate, tasks
from keyfold.sources.readers import parse_config

#: Initial allocations by name: (tasks, receivers) to an allocation.
PARTITION: dict[str, Callable[[DataFrame, int], DataFrame]] = {"lpt": allocate.lpt, "naive": allocate.by_hash, "ownership": allocate.by_ownership, "generated": allocate.by_key_suffix}


def partition_strategy(name: str) -> Callable[[DataFrame, int], DataFrame]:
    if name not in PARTITION:
        raise KeyError(f"unknown partition strategy {name!r}; there are {', '.join(sorted(PARTITION))}")
    return PARTITION[name]


def cost_strategy(text: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """``(multiplier, m)``, ``(hardware, latency, bytes, read, network, values)``; anything else, numbers that are
    not whole included, counts values."""
    if m := re.fullmatch(r"\(\s*multiplier\s*,\s*(\d+)\s*\)", text):
        return lambda t, agents: tasks.cost_remote_multiplier(t, agents, int(m[1]))
    if m := re.fullmatch(r"\(\s*hardware\s*((?:,\s*\d+\s*){5})\)", text):
        return lambda t, agents: tasks.cost_hardware(t, agents, *map(int, re.findall(r"\d+", m[1])))
    return lambda t, agents: tasks.cost_nb_values(t)


def bundle_strategy(text: str, threshold: float = 0.0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What each owner would delegate next: (owned tasks, loads) to rows by owner. A threshold of 1 delegates nothing."""
    if threshold >= 1:
        return lambda t, loads: t.select("owner", "key").limit(0)
    if text in ("csdb", "cbds"):
        return lambda t, loads: tasks.next_task(t, text).select("owner", "delegate")
    if m := re.fullmatch(r"\(\s*k-eligible-(?:small|big)\s*,\s*(\d+)\s*\)", text):
        return lambda t, loads: tasks.k_eligible_delegate(t, loads, int(m[1]), threshold)
    if text == "ownership":
        return lambda t, loads: tasks.ownership_bundle_order(t).where("delegate_place = 1").select("owner", "key")
    raise KeyError(f"unknown bundle strategy {text!r}")


def perform_strategy(text: str) -> Callable[[DataFrame], DataFrame]:
    """What each owner performs next: owned tasks to ``owner, perform``."""
    k_eligible = re.fullmatch(r"\(\s*k-eligible-(small|big)\s*,\s*\d+\s*\)", text)
    if text in ("csdb", "cbds") or k_eligible:
        policy = {"small": "csdb", "big": "cbds"}[k_eligible[1]] if k_eligible else text
        return lambda t: tasks.next_task(t, policy).select("owner", "perform")
    if text == "ownership":
        return lambda t: tasks.ownership_bundle_order(t).where("perform_place = 1").select("owner", F.col("key").alias("perform"))
    raise KeyError(f"unknown bundle strategy {text!r}")


def split_strategy(config: RunConfig) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Which owners split their costliest task, and how: (loads, owned tasks) to ``owner, delta, k, result``.

    Without the permission ``task_split`` nothing is split.
    """
    if not config.task_split:
        return lambda loads, t: tasks.k_split_choice(loads, t, config.chunk_size).limit(0)
    return lambda loads, t: tasks.k_split_choice(loads, t, config.chunk_size)


@dataclass(frozen=True)
class RunConfig:
    """A run's settings with defaults; texts are converted to the fields' types."""

    problem: str = "countWords"
    result_path: str = ""
    nb_mapper: int = 8
    nb_reducer: int = 8
    chunk_size: int = 50_000
    threshold: float = 0.0
    task_split: bool = False
    partition_strategy: str = "lpt"
    task_cost_strategy: str = "nb-values"
    task_bundle: str = "csdb"

    @classmethod
    def parse(cls, lines: Iterable[str]) -> RunConfig:
        """From ``field : value`` lines; unknown fields are ignored."""
        convert = {"int": int, "float": float, "str": str, "bool": lambda x: x.lower() == "true"}
        given = {k.replace("-", "_"): v for k, v in parse_config(lines).items()}
        return cls(**{f.name: convert[str(f.type)](given[f.name]) for f in fields(cls) if f.name in given})


def expand_sweep(lines: Iterable[str]) -> list[dict[str, str]]:
    """All configurations of a sweep: a field that begins with ``*`` lists its values, separated by commas."""
    out: list[dict[str, str]] = [{}]
    for name, value in parse_config(lines).items():
        values = [v.strip() for v in value.split(",")] if name.startswith("*") else [value]
        out = [c | {name.lstrip("*").strip(): v} for c in out for v in values]
    return out


def sweep_folders(lines: Iterable[str]) -> dict[str, dict[str, str]]:
    """Each configuration of a sweep by the name of its folder: the swept fields in order, ``field-value`` joined by ``_``, without spaces."""
    lines = list(lines)
    swept = sorted(name.lstrip("*").strip() for name in parse_config(lines) if name.startswith("*"))
    return {"_".join(f"{n}-{c[n]}" for n in swept).replace(" ", ""): c for c in expand_sweep(lines)}
