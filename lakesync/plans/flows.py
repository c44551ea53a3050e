"""Flows: steps linked by the tables they read and write."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from lakesync.sources.tables import TableStore

KINDS = ("sync", "query", "score", "action")
NAME = re.compile(r"^[A-Za-z0-9_-]+$")


@dataclass(frozen=True)
class Step:
    """One step: ``make`` turns its input tables into the rows of its output table."""

    step_id: str
    kind: str
    out: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class StepResult:
    step_id: str
    kind: str
    status: str
    rows: int
    error: str = ""


def check_flow(name: str, steps: Sequence[Step]) -> None:
    if not NAME.match(name):
        raise ValueError("flow names are letters, digits, dash and underscore")
    seen, made = set(), {s.out for s in steps}
    for step in steps:
        if not step.step_id or step.step_id in seen:
            raise ValueError(f"empty or duplicate step id {step.step_id!r}")
        seen.add(step.step_id)
        if step.kind not in KINDS:
            raise ValueError(f"no such kind of step: {step.kind!r}")
        unknown = [t for t in step.inputs if t not in made]
        if unknown:
            raise ValueError(f"step {step.step_id!r} reads tables no step makes: {unknown}")


def in_order(steps: Sequence[Step]) -> list[Step]:
    """Steps after those that make their inputs; the given order decides between free ones."""
    maker = {s.out: s.step_id for s in steps}
    by_id = {s.step_id: s for s in steps}
    graph = {s.step_id: [maker[t] for t in s.inputs] for s in steps}
    try:
        return [by_id[i] for i in TopologicalSorter(graph).static_order()]
    except CycleError as error:
        raise ValueError(f"flow has a cycle: {error.args[1]}") from error


def run_flow(
    store: TableStore, name: str, steps: Sequence[Step], run_id: str, approved: bool = False,
    dry_run: bool = False, force: bool = False,
) -> list[StepResult]:
    """Run steps in order, each one job that publishes its table.

    A step that an earlier try of the same run finished is skipped unless
    ``force`` is set; the first failure stops the flow.  Flows with an action
    step need approval before anything runs.  A dry run only gives the order.
    """
    check_flow(name, steps)
    ordered = in_order(steps)
    if dry_run:
        return [StepResult(s.step_id, s.kind, "dry_run", 0) for s in ordered]
    if not approved and any(s.kind == "action" for s in steps):
        raise PermissionError(f"flow {name!r} has action steps and was not approved")
    results = []
    for step in ordered:
        step_run = f"{run_id}-{name}-{step.step_id}"
        if force:
            step_run += f"-{len(store.log())}"
        if store.committed(step_run):
            results.append(StepResult(step.step_id, step.kind, "skipped", 0))
            continue
        try:
            rows = store.overwrite(step.out, step_run, step.make({t: store.read(t) for t in step.inputs}))
        except Exception as error:
            results.append(StepResult(step.step_id, step.kind, "failed", 0, type(error).__name__))
            break
        results.append(StepResult(step.step_id, step.kind, "completed", rows))
    return results
