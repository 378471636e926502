"""Changes between two versions of a table, field by field, and a three-way merge that takes chosen ones back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def _text(table: DataFrame, side: str, field: str) -> Column:
    """A value as text that ``_value`` reads back: nested values as JSON, bytes in base 64."""
    kind, value = table.schema[field].dataType.simpleString(), F.col(f"{side}.`{field}`")
    if kind == "binary":
        return F.base64(value)
    return F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")


def _value(table: DataFrame, field: str, text: Column) -> Column:
    kind = table.schema[field].dataType
    name = kind.simpleString()
    if name == "binary":
        return F.unbase64(text)
    return F.from_json(text, kind) if name.startswith(("array", "struct", "map")) else text.cast(kind)


def _matches(left: str, right: str, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & (F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`"))
    return out


def changes(old: DataFrame, new: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """(key, change, field, old, new): a row for each field that differs between two versions of a table.

    A row that only one version holds gives a row for each of its fields that is not null, and at least one without
    a field. Values are texts; nulls are told from empty texts. Keys are not null and unique in either version.
    """
    fields = fields or [c for c in new.columns if c not in key]
    a, b = old.withColumn("_there", F.lit(True)).alias("a"), new.withColumn("_there", F.lit(True)).alias("b")
    both = a.join(b, _matches("a", "b", key), "full_outer")
    change = F.when(F.col("a._there").isNull(), ADDED).when(F.col("b._there").isNull(), REMOVED).otherwise(CHANGED)
    pair = lambda c: F.struct(F.lit(c).alias("field"), _text(old, "a", c).alias("old"), _text(new, "b", c).alias("new"))
    differing = F.filter(F.array(*map(pair, fields)), lambda x: ~x["old"].eqNullSafe(x["new"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    listed = F.when((F.size(differing) == 0) & (change != CHANGED), none).otherwise(differing)
    keys = [F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in key]
    return both.select(*keys, change.alias("change"), F.explode(listed).alias("x")).select(*key, "change", "x.*")


def taken_back(current: DataFrame, undone: DataFrame, key: list[str], fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``current`` without the changes ``undone`` (as from ``changes``) of ``fields``, and the conflicts.

    A field goes back to its old value where it still has the new one. Where it has been changed since, it stays, and the
    conflicts (key, field, old, new, current) have a row. A row that the changes added goes if it is as they left it; a row
    that they removed comes back unless its key is there again. ``fields`` limits what goes back to some
    fields and leaves added and removed rows alone.
    """
    chosen = [c for c in current.columns if c not in key] if fields is None else fields
    edits = undone.filter((F.col("change") == CHANGED) & F.col("field").isin(*chosen))
    gathered = edits.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("old", "new")))).alias("_edits"))
    rows = current.alias("c").join(gathered.alias("e"), _matches("c", "e", key), "left")
    edit = lambda c: F.try_element_at(F.col("e._edits"), F.lit(c))
    untouched = lambda c: edit(c)["new"].eqNullSafe(_text(current, "c", c))
    held = lambda c: F.map_contains_key(F.coalesce(F.col("e._edits"), F.create_map().cast("map<string,struct<old:string,new:string>>")), F.lit(c))
    new = {c: F.when(held(c) & untouched(c), _value(current, c, edit(c)["old"])).otherwise(F.col(f"c.`{c}`")) for c in chosen}
    merged = rows.select(*(new[c].alias(c) if c in new else F.col(f"c.`{c}`") for c in current.columns))
    clash = F.filter(
        F.array(*(F.when(held(c) & ~untouched(c), F.struct(F.lit(c).alias("field"), edit(c)["old"].alias("old"), edit(c)["new"].alias("new"), _text(current, "c", c).alias("current"))) for c in chosen)),
        lambda x: x.isNotNull(),
    )
    conflicts = rows.select(*(F.col(f"c.`{k}`") for k in key), F.explode(clash).alias("x")).select(*key, "x.*")
    if fields is not None:
        return merged, conflicts
    values = lambda kind, side: undone.filter(F.col("change") == kind).groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", side)))).alias("_values")
    )
    state = lambda c: F.try_element_at(F.col("_values"), F.lit(c))
    added = values(ADDED, "new")
    there = merged.alias("m").join(added.alias("v"), _matches("m", "v", key), "left")
    same = F.lit(True)
    for c in chosen:
        same = same & state(c).eqNullSafe(_text(current, "m", c))
    merged = there.filter(~(F.col("v._values").isNotNull() & same)).select(*(F.col(f"m.`{c}`") for c in current.columns))
    removed = values(REMOVED, "old").join(current.select(*key), key, "left_anti")
    back = removed.select(*(F.col(c) if c in key else _value(current, c, state(c)).alias(c) for c in current.columns))
    return merged.union(back), conflicts
