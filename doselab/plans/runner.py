"""A plan of named steps that can be run again: what has its product is left alone, what fails stops only what needs it.

A plan is a mapping from names to steps. run() walks it in waves: a step is ready once all that it needs is available,
so the order of the mapping only breaks ties. Outcomes go to a journal, a file of one JSON object a line; the last line
of a name counts, and a line that was cut off by a crash is skipped by read_journal().
"""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Collection, Mapping
from pathlib import Path
from typing import NamedTuple

MADE, PRESENT, BROKEN, WAITING = "made", "present", "broken", "waiting"


class Step(NamedTuple):
    """make: does the work. present: whether its product is there already. needs: names of steps before it."""

    make: Callable[[], object]
    present: Callable[[], bool] = bool
    needs: tuple[str, ...] = ()


class Outcome(NamedTuple):
    state: str
    took: float = 0.0
    why: str = ""


def check(plan: Mapping[str, Step]) -> None:
    """Raises where a step needs a name that is not in the plan, or itself by way of others."""
    unknown = {n for s in plan.values() for n in s.needs} - plan.keys()
    if unknown:
        raise KeyError(f"no step is named {', '.join(sorted(unknown))}")
    open_ = {name: set(s.needs) for name, s in plan.items()}
    while free := [name for name, needs in open_.items() if not needs]:
        open_ = {name: needs - set(free) for name, needs in open_.items() if needs}
    if open_:
        raise ValueError(f"steps need each other: {', '.join(sorted(open_))}")


def run(plan: Mapping[str, Step], journal: str | Path | None = None, again: Collection[str] = (), only: Collection[str] | None = None) -> dict[str, Outcome]:
    """Outcomes by name. again: made even if present. only: the steps to look at; others count as available if present."""
    check(plan)
    chosen = [name for name in plan if only is None or name in only]
    known: dict[str, Outcome] = {}

    def available(name: str) -> bool:
        if name in chosen:
            return name in known and known[name].state in (MADE, PRESENT)
        return plan[name].present()

    while ready := [name for name in chosen if name not in known and all(map(available, plan[name].needs))]:
        for name in ready:
            known[name] = _take(plan[name], name in again)
            _note(journal, name, known[name])
    for name in chosen:
        if name not in known:
            lacking = [n for n in plan[name].needs if not available(n)]
            # Its own product may be there all the same.
            known[name] = Outcome(PRESENT) if name not in again and plan[name].present() else Outcome(WAITING, why=f"for {', '.join(lacking)}")
            _note(journal, name, known[name])
    return known


def _take(step: Step, again: bool) -> Outcome:
    if not again and step.present():
        return Outcome(PRESENT)
    clock = time.perf_counter()
    try:
        step.make()
    except Exception:  # noqa: BLE001 - what does not need this step goes on
        return Outcome(BROKEN, time.perf_counter() - clock, traceback.format_exc(limit=3))
    return Outcome(MADE, time.perf_counter() - clock)


def _note(journal: str | Path | None, name: str, outcome: Outcome) -> None:
    if journal is not None:
        with open(journal, "a", encoding="utf-8") as lines:
            lines.write(json.dumps({"step": name, **outcome._asdict()}) + "\n")


def read_journal(journal: str | Path) -> dict[str, Outcome]:
    """The last outcome of every name."""
    out = {}
    for line in Path(journal).read_text(encoding="utf-8").splitlines():
        try:
            entry = json.loads(line)
        except json.JSONDecodeError:
            continue
        name = entry.pop("step")
        out[name] = Outcome(**entry)
    return out


def tally(outcomes: Mapping[str, Outcome]) -> dict[str, int]:
    """How many steps are in each state."""
    states = [o.state for o in outcomes.values()]
    return {s: states.count(s) for s in dict.fromkeys(states)}


def status_code(outcomes: Mapping[str, Outcome]) -> int:
    """1 if a step broke, else 0; steps that wait for it are not counted again."""
    return 1 if BROKEN in tally(outcomes) else 0
