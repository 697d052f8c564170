"""Stages that can be taken up again (Q6, Q7): each compares fingerprints with its stored manifest, skips what agrees and stops or runs on what doesn't.

A source's fingerprint is the listing of its files (names, sizes, times), so an unchanged source isn't read. A stage's input is known by the
digest of what the stage before wrote: a stage that runs again with equal rows lets those behind it rest. A manifest also holds the
settings, a digest of the stage's code and the versions it ran with; only what changes results counts for the fingerprint.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import platform
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession

from caselight.operators import quality
from caselight.sources.commits import Store, _fs


class ChangedError(RuntimeError):
    """A stored stage doesn't agree with its inputs, settings or code."""


@dataclass(frozen=True)
class Stage:
    """A named table, made by a function of its inputs (sources or earlier stages) and settings."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    settings: dict = field(default_factory=dict)


def _sha(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files at a path; reads no file."""
    p, fs = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        if not s.getPath().getName().startswith(("_", ".")):
            found.append(f"{s.getPath().toUri().getPath()}\x1e{s.getLen()}\x1e{s.getModificationTime()}")
    return _sha(*sorted(found))


def code_fingerprint(f: Callable) -> str:
    """Digest of a function's source text, its own and not that of what it calls."""
    return _sha(inspect.getsource(f))


class Runner:
    """Runs stages into a store and keeps their manifests with each commit."""

    def __init__(self, spark: SparkSession, root: str, sources: dict[str, str]):
        self.spark, self.store, self.sources = spark, Store(spark, root), dict(sources)

    def manifest(self, stage: str) -> dict | None:
        """The stored manifest of a stage."""
        if not self.store.has(stage):
            return None
        return next((m for v in range(self.store.version(), 0, -1) if (m := self.store.entry(v)["note"]).get("stage") == stage), None)

    def run(self, stages: list[Stage], on_change: str = "rerun") -> dict[str, str]:
        """What became of each stage: "skipped" or "ran". With on_change "stop", a stored stage that doesn't agree is an error before it or anything behind it runs."""
        if on_change not in ("rerun", "stop"):
            raise ValueError(f"unknown answer to changes {on_change}")
        known, out = {}, {}
        for s in stages:
            parts = {name: known[name] if name in known else file_fingerprint(self.spark, self.sources[name]) for name in s.inputs}
            wanted = {"inputs": parts, "settings": json.dumps(s.settings, sort_keys=True), "code": code_fingerprint(s.make)}
            stored = self.manifest(s.name)
            changed = [k for k in wanted if stored is None or stored["made_from"][k] != wanted[k]]
            if stored is not None and not changed:
                known[s.name], out[s.name] = stored["digest"], "skipped"
                continue
            if stored is not None and on_change == "stop":
                raise ChangedError(f"{s.name}: {', '.join(changed)} changed since it was stored")
            known[s.name] = self._make(s, wanted, known)
            out[s.name] = "ran"
        return out

    def _input(self, name: str, known: dict) -> DataFrame:
        return self.store.read(name) if name in known else self.spark.read.parquet(self.sources[name])

    def _make(self, s: Stage, wanted: dict, known: dict) -> str:
        note: dict = {}

        def describe(tables: dict[str, DataFrame]) -> None:
            row = quality.manifest({s.name: tables[s.name]}, {}).first()
            note.update(stage=s.name, rows=row.rows, digest=row.digest, made_from=wanted, columns=tables[s.name].columns, host=platform.node(), versions={"python": platform.python_version(), "spark": pyspark.__version__})

        self.store.commit({s.name: s.make(*(self._input(i, known) for i in s.inputs), **s.settings)}, note=note, checks=describe)
        return note["digest"]

    def manifests(self) -> DataFrame:
        """stage, version, rows, digest, settings of every commit, as a table."""
        rows = [(m["stage"], v, m["rows"], m["digest"], m["made_from"]["settings"]) for v in range(1, self.store.version() + 1) if (m := self.store.entry(v)["note"]).get("stage")]
        return self.spark.createDataFrame(rows, "stage string, version long, rows long, digest string, settings string")
