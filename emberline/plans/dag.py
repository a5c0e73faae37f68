"""Steps with dependencies, retries and results that a later run goes on from."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import ensemble
from emberline.plans import detectors
from emberline.sources import registry
from emberline.spec import DEFAULT, FeatureSpec, Preset


@dataclass(frozen=True)
class Step:
    """``run`` gets the results of the steps named in ``after``, and is tried again so many times after a wait."""

    name: str
    run: Callable[..., DataFrame]
    after: tuple[str, ...] = ()
    retries: int = 1
    wait_seconds: float = 120.0


def attempt(step: Step, given: list[DataFrame]) -> DataFrame:
    for left in range(step.retries, -1, -1):
        try:
            return step.run(*given)
        except Exception:
            if not left:
                raise
            time.sleep(step.wait_seconds)
    raise AssertionError("unreachable")


def run_steps(spark: SparkSession, steps: list[Step], folder: str, together: int = 4, again: bool = False) -> dict[str, DataFrame]:
    """Saves the result of each step in the folder; steps that don't wait for each other run at the same time.

    A step with a saved result isn't run, unless ``again`` is set or a step before it was run. After a failure the steps
    under way end, no other one begins, and the error is raised; what they saved stays for the next run.
    """
    known = {s.name: s for s in steps}
    if len(known) < len(steps):
        raise ValueError("two steps of one name")
    unknown = {a for s in steps for a in s.after} - set(known)
    if unknown:
        raise ValueError(f"no step named {', '.join(sorted(unknown))}")
    order = TopologicalSorter({s.name: s.after for s in steps})
    order.prepare()
    done: dict[str, DataFrame] = {}
    fresh: set[str] = set()

    def work(step: Step) -> DataFrame:
        if not again and not fresh.intersection(step.after) and registry.saved(spark, folder, step.name):
            return registry.load(spark, folder, step.name)
        made = attempt(Step(step.name, lambda *given: registry.save(step.run(*given), folder, step.name), step.after, step.retries, step.wait_seconds), [done[a] for a in step.after])
        fresh.add(step.name)
        return made

    with ThreadPoolExecutor(together) as pool:
        running: dict[Future, str] = {}
        while order.is_active():
            running |= {pool.submit(work, known[n]): n for n in order.get_ready()}
            ended, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in ended:
                name = running.pop(f)
                done[name] = f.result()
                order.done(name)
    return done


def anomaly_steps(load: Callable[[], DataFrame], spec: FeatureSpec, preset: Preset = DEFAULT, names: list[str] | None = None, wait_seconds: float = 120.0) -> list[Step]:
    """load -> prepare -> one step for each detector -> votes -> report."""
    chosen = names or list(detectors.DETECTORS)
    known = detectors.DETECTORS | detectors.FOUR
    flags = [f"{n}_flag" for n in chosen]

    def detect(name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: known[name](detectors.Inputs(rows, spec, preset)).select(spec.id, f"{name}_flag")

    def votes(rows: DataFrame, *scores: DataFrame) -> DataFrame:
        joined = ensemble.join_flags(rows.select(spec.id, *spec.features), spec.id, {n: (s, f"{n}_flag") for n, s in zip(chosen, scores)})
        return ensemble.vote(joined, flags, share=preset.votes_share)

    return [
        Step("load", load, wait_seconds=wait_seconds),
        Step("prepare", lambda rows: detectors.prepared(rows, spec), ("load",), wait_seconds=wait_seconds),
        *(Step(n, detect(n), ("prepare",), 2 if n in detectors.TRAINED else 1, wait_seconds * (1.5 if n in detectors.TRAINED else 1)) for n in chosen),
        Step("votes", votes, ("prepare", *chosen), wait_seconds=wait_seconds),
        Step("report", lambda v: ensemble.top(v, spec.id), ("votes",), wait_seconds=wait_seconds),
        Step("totals", lambda v: v.agg(*(F.sum(f).cast("long").alias(f) for f in (*flags, "ensemble")), F.count("*").alias("n")), ("votes",), wait_seconds=wait_seconds),
    ]
