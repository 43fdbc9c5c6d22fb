"""Enrichment as a graph of stages over columns: declare, check, order, run with holes that cascade."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``run`` takes the columns of the needed slots (or of the record for none) and gives the slot's value; a null value is a
    failure, a value over ``budget`` bytes is one too."""

    name: str
    slot: str
    run: Callable[..., Column]
    needs: tuple[str, ...] = ()
    version: str = "v1"
    required: bool = False
    budget: int = 65_536


@dataclass
class Registry:
    """Stages by name."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def add(self, stage: Stage) -> Stage:
        """Register a stage; its name and its slot must be new."""
        if not stage.name or not stage.slot or stage.budget <= 0:
            raise ValueError("a stage needs a name, a slot and a budget")
        if stage.name in self.stages or any(s.slot == stage.slot for s in self.stages.values()):
            raise ValueError(f"stage or slot is taken: {stage.name}, {stage.slot}")
        self.stages[stage.name] = stage
        return stage

    def resolved(self) -> list[Stage]:
        """Stages in an order that respects needs; unknown needs, cycles and required stages after optional ones raise."""
        by_slot = {s.slot: s for s in self.stages.values()}
        for s in self.stages.values():
            for n in s.needs:
                if n not in by_slot:
                    raise ValueError(f"{s.name} needs an unknown slot: {n}")
                if s.required and not by_slot[n].required:
                    raise ValueError(f"{s.name} is required but needs the optional {n}")
        done, order = set(), []
        while len(order) < len(self.stages):
            ready = sorted(s.name for s in self.stages.values() if s.name not in done and set(s.needs) <= {x.slot for x in order})
            if not ready:
                raise ValueError("the stages need each other in a cycle")
            done.update(ready)
            order += [self.stages[n] for n in ready]
        return order

    def version(self) -> str:
        """All stages' versions, sorted and joined."""
        return "+".join(sorted(f"{s.name}@{s.version}" for s in self.stages.values()))


def enrich(records: DataFrame, registry: Registry) -> DataFrame:
    """Per record a struct column per slot (value, version, status) and ``record_ok``.

    status: ok, failed (null or over budget) or cancelled (a needed slot is not ok). A record is ok if all its required
    stages are. All stages of a level are one projection."""
    order = registry.resolved()
    placed: set[str] = set()
    while len(placed) < len(order):
        level = [s for s in order if s.slot not in placed and set(s.needs) <= placed]
        made = {}
        for s in level:
            value = s.run(*[F.col(f"{n}.value") for n in s.needs])
            fits = value.isNotNull() & (F.octet_length(F.to_json(F.struct(value.alias("v")))) <= s.budget)
            deps = [F.col(f"{n}.status") != "ok" for n in s.needs]
            status = F.when(F.lit(False) if not deps else _any(deps), "cancelled").when(~fits, "failed").otherwise("ok")
            made[s.slot] = F.struct(F.when(status == "ok", value).alias("value"), F.lit(s.version).alias("version"), status.alias("status"))
        records = records.withColumns(made)
        placed |= {s.slot for s in level}
    needed = [F.col(f"{s.slot}.status") == "ok" for s in order if s.required]
    return records.withColumn("record_ok", ~_any([~c for c in needed]) if needed else F.lit(True)).withColumn("pipeline_version", F.lit(registry.version()))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
