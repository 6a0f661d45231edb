"""Curation state: pure functions from a state and its changes to the next state.

Files are immutable, so there is no in-place update: a change is a union and a choice per key, a deletion an anti-join.
Counters floored at zero depend on the order of their changes and are folded per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last wins: per key the change with the greatest ``order``, else the old row.  A map-side combine, no window.

    Ties in ``order`` go to the greater row.
    """
    columns = state.columns
    rows = state.select("*", F.lit(0).alias("__new"), F.lit(None).cast(dict(changes.dtypes)[order]).alias("__at"))
    rows = rows.unionByName(changes.select(*columns, F.lit(1).alias("__new"), F.col(order).alias("__at")))
    rest = [c for c in columns if c not in keys]
    best = F.max(F.struct("__new", "__at", *rest)).alias("b")
    return rows.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in columns])


def insert_ignore(state: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First wins: rows whose keys are not there yet, the least of equals."""
    columns = state.columns
    rest = [c for c in columns if c not in keys]
    fresh = rows.join(state.select(*keys), list(keys), "left_anti")
    if rest:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("b")).select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in columns])
    else:
        fresh = fresh.select(*columns).distinct()
    return state.unionByName(fresh)


def delete(state: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without the rows whose keys (null-safe) are in ``doomed``."""
    other = doomed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    condition = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = equal if condition is None else condition & equal
    return state.join(other, condition, "left_anti")


def replace_group(state: DataFrame, rows: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """All rows of the touched keys are replaced (as when a file is indexed again, maybe with no result)."""
    return delete(state, rows if touched is None else touched, keys).unionByName(rows.select(*state.columns))


def floored_counters(changes: DataFrame, key: str, order: str = "at", delta: str = "delta", start: DataFrame | None = None, width: int = 86_400) -> DataFrame:
    """(key, count): each change adds its delta, never below zero.

    The fold acc -> max(0, acc + d) of a run of changes is the function x -> max(floor, x + sum), and such functions
    compose.  So the changes of a key are folded run by run, a run being ``width`` of ``order`` (a number), and only the
    runs' two numbers meet: a key with very many changes is spread over as many tasks as it has runs.
    """
    zero = F.lit(0).cast("long")
    runs = changes.groupBy(key, F.floor(F.col(order) / width).alias("__run")).agg(F.array_sort(F.collect_list(F.struct(order, delta))).alias("c"))
    steps = F.transform("c", lambda x: x[delta].cast("long"))
    least = F.aggregate(steps, F.lit(-(2**62)).cast("long"), lambda acc, d: F.greatest(zero, acc + d))
    pieces = runs.select(key, F.struct("__run", least.alias("least"), F.aggregate(steps, zero, lambda acc, d: acc + d).alias("sum")).alias("piece"))
    folded = pieces.groupBy(key).agg(F.array_sort(F.collect_list("piece")).alias("p"))
    if start is not None:
        folded = folded.join(start.select(key, F.col("count").alias("__start")), key, "full")
    begin = F.coalesce("__start", zero).cast("long") if start is not None else zero
    count = F.aggregate("p", begin, lambda acc, x: F.greatest(x["least"], acc + x["sum"]))
    return folded.select(key, F.when(F.col("p").isNull(), begin).otherwise(count).alias("count"))


def favourite_counters(changes: DataFrame, key: str) -> DataFrame:
    """Floored counters where a row exists only above zero."""
    return floored_counters(changes, key).where("count > 0")


def rename_or_merge(definitions: DataFrame, links: DataFrame, old: str, new: str, name: str = "label", link: str = "tag_id") -> tuple[DataFrame, DataFrame]:
    """(definitions, links) after renaming ``old``: if ``new`` exists its id takes over the links and ``old`` goes."""
    target = definitions.where(F.col(name) == new).agg(F.min("id").alias("target"))
    source = definitions.where(F.col(name) == old).agg(F.min("id").alias("source"))
    ids = F.broadcast(target.join(source, F.lit(True)))  # one row
    moved = links.join(ids, F.lit(True)).withColumn(link, F.when((F.col(link) == F.col("source")) & F.col("target").isNotNull(), F.col("target")).otherwise(F.col(link))).select(*links.columns).distinct()
    defs = definitions.join(ids, F.lit(True)).where(~((F.col("id").eqNullSafe(F.col("source"))) & F.col("target").isNotNull()))
    defs = defs.withColumn(name, F.when(F.col("id").eqNullSafe(F.col("source")), F.lit(new)).otherwise(F.col(name)))
    return defs.select(*definitions.columns), moved


def rename_value(tables: Sequence[DataFrame], column: str, old: str, new: str) -> list[DataFrame]:
    """A name changed in several tables; rows that become equal merge."""
    return [t.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))).distinct() for t in tables]


def merge_groups(sets: DataFrame, members: DataFrame, links: Sequence[DataFrame], merges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Merge many sets at once.  ``merges``: source, dest.  Members and links are united, favourites summed."""
    to = merges.select(F.col("source").alias("set_id"), F.col("dest").alias("__dest"))

    def moved(t: DataFrame) -> DataFrame:
        return t.join(to, "set_id", "left").withColumn("set_id", F.coalesce("__dest", "set_id")).select(*t.columns)

    rest = [c for c in members.columns if c not in ("set_id", "checksum")]
    united = moved(members)
    if rest:
        united = united.groupBy("set_id", "checksum").agg(F.min(F.struct(*rest)).alias("b")).select(*[F.col(c) if c not in rest else F.col(f"b.{c}").alias(c) for c in members.columns])
    else:
        united = united.distinct()
    favourites = moved(sets.select(F.col("id").alias("set_id"), "favorite")).groupBy("set_id").agg(F.sum("favorite").alias("favorite"))
    left = sets.drop("favorite").join(merges.select(F.col("source").alias("id")), "id", "left_anti")
    left = left.join(favourites.withColumnRenamed("set_id", "id"), "id", "left").select(*sets.columns)
    return left, united, [moved(t).distinct() for t in links]


def delete_with_links(definitions: DataFrame, links: Sequence[DataFrame], doomed: DataFrame, link: str) -> tuple[DataFrame, list[DataFrame]]:
    """A definition and, as documented, all rows that link to it."""
    gone = doomed.select("id").distinct()
    return definitions.join(gone, "id", "left_anti"), [t.join(gone.withColumnRenamed("id", link), link, "left_anti") for t in links]


def set_positions(members: DataFrame, ordered: DataFrame) -> DataFrame:
    """Dense manual positions: ``ordered`` is (set_id, checksums array); others keep theirs."""
    places = ordered.select("set_id", F.posexplode("checksums").alias("__pos", "checksum")).groupBy("set_id", "checksum").agg(F.min("__pos").alias("__pos"))
    return members.join(places, ["set_id", "checksum"], "left").withColumn("position", F.coalesce(F.col("__pos").cast("long"), F.col("position"))).select(*members.columns)


def assign_with_exclusions(members: DataFrame, exclusions: DataFrame, added: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Membership is added once and clears the exclusion of the same pair."""
    return insert_ignore(members, added, keys), delete(exclusions, added, keys)


def create_sets(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Create on (name, studio), null-safe: a pair that exists is not created again.  New ids are unique above the greatest."""
    other = sets.select(F.col("name").alias("__n"), F.col("studio").alias("__s"))
    fresh = wanted.select("name", "studio").distinct().join(other, F.col("name").eqNullSafe(F.col("__n")) & F.col("studio").eqNullSafe(F.col("__s")), "left_anti")
    top = sets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = fresh.select((F.monotonically_increasing_id() + top + 1).alias("id"), "name", "studio")
    return sets.unionByName(numbered, allowMissingColumns=True)


def promote_faces(manual: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on detected faces, last wins per source_face_id; ``undo`` takes the row away.

    ``decisions``: source_face_id, checksum, identity, action (confirm, reject, undo), at.
    """
    last = decisions.groupBy("source_face_id").agg(F.max(F.struct("at", "action", "checksum", "identity")).alias("d")).select("source_face_id", "d.*")
    old = manual.join(last.select("source_face_id"), "source_face_id", "left_anti")
    new = last.where("action <> 'undo'").select(
        "source_face_id", "checksum", F.when(F.col("action") == "confirm", F.col("identity")).alias("identity"), (F.col("action") == "reject").alias("rejected")
    )
    return old.unionByName(new.select(*old.columns))


def migrate_refs(ages: DataFrame, promoted: DataFrame) -> DataFrame:
    """Age estimates of an auto face follow it to its manual row unless that has one already.

    ``ages``: face_ref, ...; ``promoted``: auto_ref, manual_ref.
    """
    taken = ages.select(F.col("face_ref").alias("manual_ref"), F.lit(True).alias("__taken")).distinct()
    to = promoted.join(taken, "manual_ref", "left").where("__taken IS NULL").select(F.col("auto_ref").alias("face_ref"), "manual_ref")
    return ages.join(to, "face_ref", "left").withColumn("face_ref", F.coalesce("manual_ref", "face_ref")).select(*ages.columns)


def resolve_alias(names: DataFrame, aliases: DataFrame, name: str = "identity") -> DataFrame:
    """Adds ``resolved``: the owner of an alias, else the name itself."""
    owners = aliases.select(F.col("alias").alias(name), "owner")
    return names.join(owners, name, "left").withColumn("resolved", F.coalesce("owner", name)).drop("owner")


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def flat_to_definitions(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema migration of flat tags (id, checksum, label, ...) to definitions and instances; the id is the label's least."""
    definitions = flat.groupBy("label").agg(F.min("id").alias("id")).select("id", "label")
    instances = flat.join(definitions.select(F.col("id").alias("tag_id"), "label"), "label").drop("label")
    return definitions, instances


def recover_by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): ids matched over their paths; an id claimed by several or claiming several stays out."""
    pairs = old.select(F.col("id").alias("old_id"), "path").join(new.select(F.col("id").alias("new_id"), "path"), "path").select("old_id", "new_id").distinct()
    one_old = pairs.groupBy("old_id").agg(F.min("new_id").alias("new_id"), F.count("*").alias("n")).where("n = 1")
    one_new = pairs.groupBy("new_id").agg(F.count("*").alias("n")).where("n = 1").select("new_id")
    return one_old.select("old_id", "new_id").join(one_new, "new_id", "left_semi")
