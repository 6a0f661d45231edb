"""Migrations of versioned tables: a registry, a dry run, and a new version that shows only if its row counts are right.

The tables live in versions as ``sinks.commit`` writes them; the version before is the backup, which a failed migration leaves
as the latest.  What has been done is a table of its own in each version (``migration_state``: id, done_at), so it moves
together with the tables that it speaks of.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import flat_to_definitions
from .sinks import latest, show_version, versions

STATE = "migration_state"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Migration:
    """``pending`` gives what there is to do, as the rows that each new table must have, or None; ``apply`` the new tables.

    A table that ``apply`` gives replaces the one of its name; a None drops it; all others stay.
    """

    id: str
    pending: Callable[[Tables], dict[str, int] | None]
    apply: Callable[[Tables], dict[str, DataFrame | None]]


class Mismatch(RuntimeError):
    """A migrated table has other rows than it must have."""


def _flat_pending(tables: Tables) -> dict[str, int] | None:
    """None if there is no flat table of tags, or it has its new shape already."""
    if "tags" not in tables or "checksum" not in tables["tags"].columns:
        return None
    n, labels = tables["tags"].agg(F.count("*"), F.count_distinct("label")).first()
    return {"tags": labels, "file_tags": n}


def _flat_apply(tables: Tables) -> dict[str, DataFrame | None]:
    definitions, instances = flat_to_definitions(tables["tags"])
    return {"tags": definitions, "file_tags": instances}


#: In the order in which they are applied.
MIGRATIONS = (Migration("0001_tags_table", _flat_pending, _flat_apply),)


def report(migration: Migration, counts: dict[str, int]) -> str:
    return f"{migration.id}: " + ", ".join(f"{n} rows of {name}" for name, n in sorted(counts.items()))


def run(spark: SparkSession, root: str, migrations: Sequence[Migration] = MIGRATIONS, apply: bool = False, now: int | None = None) -> list[str]:
    """What is pending, a line each; with ``apply`` each one becomes a version, one after the other, and stops at a failure.

    Without ``apply`` nothing is written.  A migration with nothing to do is noted as done with the next version that is
    written.  Rows are counted while they are written; the version's marker follows only if the counts agree.
    """
    found = versions(spark, root)
    if not found:
        return [f"{root} has no version"]
    lines, version = [], found[-1]
    tables = latest(spark, root, version=version)
    done = {r["id"] for r in tables[STATE].collect()} if STATE in tables else set()
    idle: list[str] = []
    for migration in migrations:
        if migration.id in done:
            continue
        counts = migration.pending(tables)
        if counts is None:
            idle.append(migration.id)
            continue
        lines.append(report(migration, counts))
        if apply:
            version = _written(spark, root, version, tables, migration, counts, [*idle, migration.id], now)
            tables, idle = latest(spark, root, version=version), []
    if apply and idle:
        _write(spark, root, version + 1, tables | {STATE: _state(spark, tables, idle, now)}, {})
    return lines or ["nothing pending"]


def _state(spark: SparkSession, tables: Tables, ids: list[str], now: int | None) -> DataFrame:
    at = F.unix_timestamp() if now is None else F.lit(now)
    new = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("done_at", at.cast("long"))
    return tables[STATE].unionByName(new) if STATE in tables else new


def _written(spark: SparkSession, root: str, version: int, tables: Tables, migration: Migration, counts: dict[str, int], ids: list[str], now: int | None) -> int:
    changed = migration.apply(tables)
    kept = {name: df for name, df in (tables | changed).items() if df is not None}
    _write(spark, root, version + 1, kept | {STATE: _state(spark, tables, ids, now)}, counts)
    return version + 1


def _write(spark: SparkSession, root: str, version: int, tables: Tables, counts: dict[str, int]) -> None:
    """Writes all tables, counting rows on the way, and then shows the version."""
    for name, df in tables.items():
        rows = Observation(name)
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
        if name in counts and rows.get["n"] != counts[name]:
            raise Mismatch(f"{name} has {rows.get['n']} rows instead of {counts[name]}")
    show_version(spark, root, version)
