"""Relational operators of the transcript store: search, lookups, merges, folder trees, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def optional_in(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows whose column is among ids; no or empty ids mean no filter."""
    return df.filter(F.col(column).isin(list(ids))) if ids else df


def contains_text(text: Column, query: str) -> Column:
    """Case-insensitive substring test; the query is trimmed, and an empty one matches nothing."""
    q = query.strip().lower()
    return F.contains(F.lower(text), F.lit(q)) if q else F.lit(False)


def search_segments(segments: DataFrame, projects: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Segments holding the query with their project's title, newest project first; 50 rows unless asked, 200 at most."""
    n = min(max(50 if limit is None else limit, 1), 200)
    hits = segments.filter(contains_text(F.col("text"), query)).join(projects, "project_id")
    return hits.orderBy(F.desc("updated_at"), "project_id", "idx").limit(n)


def listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): all values of each key in ascending order, joined by spaces; null values are left out, and a key without others has no
    text. Values are joined within ranges first, so that only their texts meet in the row that holds them all."""
    ranged = rows.select(key, value).repartitionByRange(key, value).withColumn("_span", F.spark_partition_id())
    parts = ranged.groupBy(key, "_span").agg(F.array_join(F.array_sort(F.collect_list(value)), " ").alias("_text"))
    texts = F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct("_span", "_text"))))
    return parts.groupBy(key).agg(texts.alias("_texts")).select(key, F.when(F.size("_texts") > 0, F.array_join(F.transform("_texts", lambda x: x["_text"]), " ")).alias(name))


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by replacement: for each key the row of the greatest order columns; a partial maximum, no sort."""
    row = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("_row.*")


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert on conflict: new values replace old ones where given (not null), columns in keep stay the old ones."""
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keys or c in keep else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, cond, "full_outer").select(*cols)


def partial_update(table: DataFrame, key: str, key_value, updates: dict, stamp: tuple[str, Column] | None = None, clear: tuple[str, ...] = ()) -> DataFrame:
    """Set the supplied columns of one row; none supplied changes nothing. clear sets columns to null."""
    given = {k: F.lit(v) for k, v in updates.items() if v is not None} | {k: F.lit(None) for k in clear}
    if not given:
        return table
    if stamp:
        given[stamp[0]] = stamp[1]
    hit = F.col(key).eqNullSafe(F.lit(key_value))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in given.items()})


def subtree(nodes: DataFrame, root) -> DataFrame:
    """(id, depth) of root and all below it in an adjacency list (id, parent_id; ids are unique). A root that doesn't exist gives no
    rows, and one that lies in a cycle is an error.

    By path doubling: each node points up, first to its parent, and in every round to where that one points, so a tree of any depth takes
    a number of rounds that is the logarithm of its levels. Nodes whose pointer ends elsewhere leave; so do those that go round in a
    cycle away from the root, once pointers are longer than any path.
    """
    root = F.lit(root).cast(nodes.schema["id"].dataType)
    start = nodes.select("id", F.when(F.col("id") == root, root).otherwise(F.col("parent_id")).alias("up"), F.when(F.col("id") == root, 0).otherwise(1).cast("long").alias("depth"))
    state = written(start.filter("up is not null"), "pointers")
    reach, most = 1, None
    while True:
        open_ = state.filter(F.col("up") != root)
        if most is None:
            if state.filter(F.col("id") == root).isEmpty():
                return state.filter(F.lit(False)).select("id", F.col("depth").cast("int").alias("depth"))
            most = state.count()
        if reach > most or open_.isEmpty():
            break
        onward = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = open_.join(onward, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state, reach = written(state.filter(F.col("up") == root).unionByName(moved), "pointers"), reach * 2
    found = state.filter(F.col("up") == root).select("id", F.col("depth").cast("int").alias("depth"))
    above = nodes.filter(F.col("id") == root).select(F.col("parent_id").alias("id"))
    if not found.join(above, "id", "left_semi").isEmpty():
        raise ValueError("the root of the subtree lies in a cycle")
    return found


def allowed_moves(nodes: DataFrame, moves: DataFrame, most: int = 2) -> DataFrame:
    """moves (moved, target) with `allowed`: a folder (nodes: id, parent_id, is_folder) may go into another folder that isn't below it
    and isn't its own parent, if nothing of it comes to lie deeper than `most`; other items may go into any other folder.

    Depths above `most` forbid a move anyway, so they are counted no further: `most` joins up, and as many down.
    """
    parent = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"))
    rows = moves.join(nodes.select(F.col("id").alias("moved"), F.col("is_folder").alias("_folder"), F.col("parent_id").alias("_from")), "moved", "left")
    rows = rows.join(nodes.select(F.col("id").alias("target"), F.col("is_folder").alias("_into")), "target", "left").withColumns({"_at": F.col("target"), "_depth": F.lit(-1), "_below": F.lit(False)})
    for _ in range(most + 1):  # from the target up
        rows = rows.withColumns({"_depth": F.col("_depth") + F.col("_at").isNotNull().cast("int"), "_below": F.col("_below") | F.coalesce(F.col("_at") == F.col("moved"), F.lit(False))})
        rows = rows.join(parent, F.col("_at") == F.col("_id"), "left").withColumn("_at", F.col("_parent")).drop("_id", "_parent")
    rows = rows.withColumn("_deep", F.col("_at").isNotNull())
    height, level = rows.select("moved").distinct().withColumns({"_at": F.col("moved"), "_height": F.lit(0)}), moves.select("moved").distinct().select("moved", F.col("moved").alias("_at"))
    height = height.select("moved", "_height")
    for k in range(1, most + 1):  # from what is moved down
        level = level.join(parent, F.col("_at") == F.col("_parent")).select("moved", F.col("_id").alias("_at"))
        height = height.unionByName(level.select("moved", F.lit(k).alias("_height")).distinct())
    rows = rows.join(height.groupBy("moved").agg(F.max("_height").alias("_height")), "moved")
    fits = ~F.col("_below") & ~F.col("_deep") & (F.col("_depth") + 1 + F.col("_height") <= most)
    into = F.col("_into") & ~F.col("target").eqNullSafe(F.col("_from")) & (F.col("target") != F.col("moved"))
    return rows.select(*moves.columns, F.coalesce(into & (~F.col("_folder") | fits), F.lit(False)).alias("allowed"))


def delete_subtree(nodes: DataFrame, root, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Cascade of deleting a folder: what is left of the nodes ('nodes') and of each table of children (table, its column of node ids)."""
    gone = subtree(nodes, root).select("id")
    return {"nodes": without_ids(nodes, gone, "id")} | {name: without_ids(table, gone, column) for name, (table, column) in children.items()}


def without_ids(table: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Cascade of a delete: the rows whose column is none of the ids."""
    return table.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_anti")


def reordered(table: DataFrame, id_col: str, order: str, ids: list) -> DataFrame:
    """Listed rows take their place in the list as their order; all others keep theirs."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col(id_col)) - 1
    return table.withColumn(order, F.when(place >= 0, place).otherwise(F.col(order)))


def created_if_absent(have: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """have, and one row for each new name that it lacks."""
    return have.unionByName(new.select(*have.columns).dropDuplicates([name]).join(have.select(name).distinct(), name, "left_anti").select(*have.columns))


def unlinked(table: DataFrame, column: str, gone: DataFrame, id_column: str = "id") -> DataFrame:
    """Deleting what a column refers to: its references to gone ids become null."""
    ids = gone.select(F.col(id_column).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return table.join(ids, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*table.columns)


def zipped(rows: DataFrame, others: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with the value that stands at the same place of each key's other list (keys, order, value)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    right = others.withColumn("_place", place).select(*keys, "_place", value)
    return rows.withColumn("_place", place).join(right, [*keys, "_place"], "left").drop("_place")


def with_title(rows: DataFrame, projects: DataFrame, default: str = "Unknown") -> DataFrame:
    """Left lookup of project titles; missing ones get the default."""
    titles = projects.select("project_id", F.col("title").alias("project_title"))
    return rows.join(titles, "project_id", "left").withColumn("project_title", F.coalesce("project_title", F.lit(default)))


def action_items(summaries: DataFrame, projects: DataFrame, schema: str, include_done: bool = True) -> DataFrame:
    """Items of each project's JSON action list with the project's columns; malformed lists hold no items."""
    items = F.coalesce(F.from_json("action_items", schema), F.array().cast(schema))
    rows = summaries.join(projects.select("project_id", F.col("title").alias("project_title")), "project_id").select("project_id", "project_title", F.explode(items).alias("item"))
    rows = rows.select("project_id", "project_title", "item.*")
    return rows if include_done else rows.filter(~F.coalesce(F.col("done"), F.lit(False)))


def first_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Merge of lists by precedence: for each key the row of the first source that has it."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_source", F.lit(k)) for k, df in enumerate(sources)])
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*sources[0].columns), "_source").alias("_row"))
    return first.select("_row.*")


def speaker_analysis(segments: DataFrame, speaker: str, duration: Column) -> DataFrame:
    """Segments and total duration per speaker; null and '' stay separate groups, both named Unknown."""
    out = segments.groupBy(speaker).agg(F.coalesce(F.sum(duration), F.lit(0)).alias("total_duration"), F.count(F.lit(1)).alias("segment_count"))
    return out.select(F.when(F.coalesce(F.col(speaker), F.lit("")) == "", "Unknown").otherwise(F.col(speaker)).alias("speaker"), "total_duration", "segment_count")


def fill_from_label(rows: DataFrame, label: str, value: str, order: list[str]) -> DataFrame:
    """Values propagate within a label: rows without one get the first one of their label. A partial minimum, joined back."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(label).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    return rows.join(first, label, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")


def majority(rows: DataFrame, parent: list[str], label: str, position: str) -> DataFrame:
    """The most frequent label per parent; of equal ones the first encountered."""
    counts = rows.groupBy(*parent, label).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("_first"))
    return counts.groupBy(*parent).agg(F.max_by(F.struct(label, "votes"), F.struct("votes", -F.col("_first"))).alias("m")).select(*parent, f"m.{label}", "m.votes")
