"""Analysis workflows: states as a graph, checked and listed as frames, and run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.errors import WorkflowError

MAX_STATES = 50
TIMEOUT_S = 1800.0


@dataclass(frozen=True)
class State:
    """A step: what it needs, what it does, where its outcomes lead."""

    name: str
    run: Callable[[dict], dict]
    needs: tuple[str, ...] = ()
    outcomes: dict[str, str] = field(default_factory=dict)
    next_outcome: Callable[[dict], str | None] = lambda result: None


class Registry:
    """States by name."""

    def __init__(self, states: tuple[State, ...] = ()) -> None:
        self._states: dict[str, State] = {}
        for state in states:
            self.add(state)

    def add(self, state: State) -> None:
        self._states[state.name] = state

    def remove(self, name: str) -> None:
        self._states.pop(self.get(name).name)

    def get(self, name: str) -> State:
        if name not in self._states:
            raise WorkflowError(f"no state {name!r}", suggestion=f"known: {', '.join(self.names())}")
        return self._states[name]

    def names(self) -> list[str]:
        return sorted(self._states)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(states, edges)."""
        states = [(n, list(self._states[n].needs), not self._states[n].outcomes) for n in self.names()]
        edges = [(n, k, d) for n in self.names() for k, d in self._states[n].outcomes.items()]
        return spark.createDataFrame(states, "state string, required_fields array<string>, is_terminal boolean"), spark.createDataFrame(edges, "src string, key string, dst string")


def entry_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States that no edge leads to, by name."""
    return states.join(edges.select(F.col("dst").alias("state")), "state", "left_anti").select("state")


def terminal_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    return states.join(edges.select(F.col("src").alias("state")), "state", "left_anti").select("state")


def problems(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, state): edges to unknown states, loops of one state, and a
    graph without entry or end."""
    broken = edges.join(states, edges["dst"] == states["state"], "left_anti").select(F.lit("unknown target").alias("problem"), F.col("dst").alias("state"))
    loops = edges.where("src = dst").select(F.lit("leads to itself").alias("problem"), F.col("src").alias("state"))
    none = [d.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(p).alias("problem"), F.lit(None).cast("string").alias("state")) for p, d in (("no entry", entry_states(states, edges)), ("no end", terminal_states(states, edges)))]
    return broken.unionByName(loops).unionByName(none[0]).unionByName(none[1]).distinct()


def simple_paths(states: DataFrame, edges: DataFrame, most: int = MAX_STATES) -> DataFrame:
    """(path): every path from an entry to an end; one that comes back to a
    state it has passed ends there, marked with an asterisk. Graphs of a
    workflow are small; the recursion is Spark's own."""
    spark = states.sparkSession
    entry_states(states, edges).createOrReplaceTempView("_entries")
    edges.select("src", "dst").distinct().createOrReplaceTempView("_edges")
    return spark.sql(
        f"""WITH RECURSIVE walk(path, at, open) MAX RECURSION LEVEL {most + 2} AS (
        SELECT array(state), state, true FROM _entries
        UNION ALL
        SELECT concat(path, array(IF(array_contains(path, dst), concat(dst, '*'), dst))), dst, NOT array_contains(path, dst)
        FROM walk JOIN _edges ON at = src WHERE open)
        SELECT array_join(path, ' > ') AS path FROM walk LEFT ANTI JOIN _edges ON at = src AND open"""
    )


def dot(edges: DataFrame) -> DataFrame:
    """The graph's edges as DOT lines."""
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "key").alias("line"))


def as_json(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(state, json): each state with its outcomes, as one JSON object."""
    out = edges.groupBy(F.col("src").alias("state")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "dst")))).alias("outcomes"))
    joined = states.join(out, "state", "left")
    return joined.select("state", F.to_json(F.struct("state", "required_fields", "is_terminal", "outcomes")).alias("json"))


@dataclass
class Run:
    """What a run did."""

    path: list[str] = field(default_factory=list)
    results: dict[str, dict] = field(default_factory=dict)
    error: str | None = None

    def log(self, spark: SparkSession) -> DataFrame:
        """(step, state, fields)."""
        rows = [(i, s, sorted(self.results.get(s, {}))) for i, s in enumerate(self.path, 1)]
        return spark.createDataFrame(rows, "step int, state string, fields array<string>")


def run(registry: Registry, start: str, context: dict, most: int = MAX_STATES, timeout: float = TIMEOUT_S) -> Run:
    """Runs states from ``start`` until one has no next. A state's error ends
    the run and is kept; the results so far stay."""
    done, name, began = Run(), start, time.monotonic()
    while name is not None:
        if len(done.path) >= most or time.monotonic() - began > timeout:
            done.error = "too many states" if len(done.path) >= most else "timeout"
            break
        state = registry.get(name)
        if missing := [n for n in state.needs if n not in context]:
            done.error = f"{name} needs {', '.join(missing)}"
            break
        done.path.append(name)
        try:
            done.results[name] = state.run(context)
        except Exception as error:  # a state may do anything; its failure is the run's result
            done.error = f"{name}: {error}"
            break
        context = context | done.results[name]
        outcome = state.next_outcome(done.results[name])
        name = state.outcomes.get(outcome) if outcome is not None else next(iter(state.outcomes.values()), None)
    return done
