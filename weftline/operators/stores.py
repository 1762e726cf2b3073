"""Groups, labels, annotations, checklists, summaries: queries and edits.

Stores are tables; an edit returns the new table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def groups_of_member(groups: DataFrame, members: DataFrame, member_type: str, path: str) -> DataFrame:
    mine = members.where((F.col("member_type") == member_type) & (F.col("path") == path)).select("name")
    return groups.join(mine, "name", "left_semi")


def search_groups(groups: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return groups.where(F.lower("name").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q))


def group_stats(groups: DataFrame, members: DataFrame, notations: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(groups, "groups").crossJoin(one(members, "members")).crossJoin(one(notations, "notations"))


def search_labels(assignments: DataFrame, labels: DataFrame, ids: list[str] | None = None, glob: str | None = None, target_type: str | None = None) -> DataFrame:
    """target, type and its label names, sorted."""
    df = assignments
    if ids:
        df = df.where(F.col("label_id").isin(ids))
    if glob:
        df = df.where(F.col("target").rlike(T.path_glob_pattern(glob)))
    if target_type:
        df = df.where(F.col("target_type") == target_type)
    df = df.join(labels.select(F.col("id").alias("label_id"), F.col("name")), "label_id")
    return df.groupBy("target").agg(F.first("target_type").alias("target_type"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("labels"))


def labels_of(assignments: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    return assignments.where(F.col("target") == target).join(labels, F.col("label_id") == F.col("id")).select(labels["*"])


def label_counts(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = assignments.groupBy(F.col("label_id").alias("id")).agg(F.count("*").alias("n"))
    return labels.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def assign(assignments: DataFrame, more: DataFrame) -> DataFrame:
    """With those of ``more`` that no row has for the same label and target."""
    fresh = more.dropDuplicates(["label_id", "target"]).join(assignments, ["label_id", "target"], "left_anti")
    return assignments.unionByName(fresh.select(*assignments.columns))


def unassign(assignments: DataFrame, label_id: str, target: str) -> DataFrame:
    return assignments.where((F.col("label_id") != label_id) | (F.col("target") != target))


def migrate(assignments: DataFrame, old: str, new: str) -> DataFrame:
    moved = assignments.withColumn("label_id", F.when(F.col("label_id") == old, new).otherwise(F.col("label_id")))
    return moved.dropDuplicates(["label_id", "target"])


def delete_label(labels: DataFrame, assignments: DataFrame, label_id: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Refuses while the label is assigned, unless forced."""
    if not force and not assignments.where(F.col("label_id") == label_id).isEmpty():
        raise ValueError(f"label {label_id} is assigned")
    return labels.where(F.col("id") != label_id), assignments.where(F.col("label_id") != label_id)


def upsert(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def remove(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return store.join(keys, on, "left_anti")


def add_item(items: DataFrame, **values) -> DataFrame:
    """A row with the next id (the largest and 1)."""
    row = items.agg((F.coalesce(F.max(F.col("item_id").cast("bigint")), F.lit(0)) + 1).cast("string").alias("item_id")).withColumns({k: F.lit(v) for k, v in values.items()})
    return items.unionByName(row.select(*items.columns))


def checklist(items: DataFrame, trigger: str) -> DataFrame:
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return items.where(F.col("trigger") == trigger).withColumn("rank", F.row_number().over(Window.orderBy(order, "item_id")))


def overlay_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """The agent's summary where there is one that isn't empty, else the heuristic one."""
    given = summaries.select("path", F.nullif("summary", F.lit("")).alias("__given"))
    return files.join(given, "path", "left").withColumn("summary", F.coalesce("__given", "summary")).drop("__given")


def search_annotations(categorised: DataFrame, query: str, category: str | None = None, severity: str | None = None, core: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Up to ``most`` rows whose raw text or value contains the query; severity is that of the core annotation on the line."""
    q = query.lower()
    df = categorised.where(F.lower("raw").contains(q) | F.lower("value").contains(q))
    if category:
        df = df.where(F.col("category") == category)
    if severity:
        if core is None:
            return df.where(F.lit(False))
        df = df.join(core.where(F.col("severity") == severity).select("path", "line"), ["path", "line"], "left_semi")
    return df.orderBy("path", "line").limit(most)


def annotations_of(inline: DataFrame, meta: DataFrame, symbols: DataFrame, path: str, symbol: str | None = None) -> DataFrame:
    """(source, line, key, value): inline ones, and meta ones with their text split at the colon; of a symbol, the inline ones on its lines."""
    own = inline.where(F.col("path") == path)
    if symbol:
        at = symbols.where((F.col("path") == path) & (F.col("name") == symbol)).orderBy("ord").limit(1).select("path", "start_line", "end_line")
        own = own.join(at, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    rows = own.select(F.lit("inline").alias("source"), "line", F.col("type").alias("key"), F.col("message").alias("value"))
    if symbol:
        return rows
    text = F.col("text")
    key = F.when(text.contains(": "), F.substring_index(text, ": ", 1)).otherwise(F.col("type"))
    value = F.when(text.contains(": "), F.substring(text, F.instr(text, ": ") + 2, F.length(text))).otherwise(text)
    return rows.unionByName(meta.where(F.col("path") == path).select(F.lit("meta").alias("source"), F.lit(None).cast("int").alias("line"), key.alias("key"), value.alias("value")))


def parse_annotation(text, tag: str = "@note") -> dict:
    """Column expressions of ``TAG.TYPE [SEVERITY] text``; ``tag`` is the project's own."""
    p = rf"^{T.quote(tag)}\.(\w+)\s+(?:\[(\w+)\]\s*)?(.*)$"
    return {"type": F.regexp_extract(text, p, 1), "severity": F.nullif(F.regexp_extract(text, p, 2), F.lit("")), "text": F.regexp_extract(text, p, 3)}


# -- groups ------------------------------------------------------------------


def set_group(groups: DataFrame, members: DataFrame, notations: DataFrame, name: str, description: str, paths: list[str], now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the group made or updated: new members come to the
    old ones, and another description leaves a notation."""
    spark = groups.sparkSession
    old = groups.where(F.col("name") == name)
    fresh = spark.createDataFrame([(name, p) for p in paths], "name string, path string").select("name", T.member_type(F.col("path")).alias("member_type"), T.member_path(F.col("path")).alias("path")).distinct()
    fresh = fresh.join(members, ["name", "member_type", "path"], "left_anti").select(*members.columns)
    row = spark.range(1).select(F.lit(name).alias("name")).join(old.select("name", F.col("created_at").alias("__created")), "name", "left")
    row = row.select("name", F.lit(description).alias("description"), F.coalesce("__created", F.lit(now)).cast("bigint").alias("created_at"), F.lit(now).cast("bigint").alias("updated_at"))
    changed = old.where(~F.col("description").eqNullSafe(description))
    said = changed.select("name", F.lit(f"Description updated: {description}").alias("text"))
    return groups.where(F.col("name") != name).unionByName(row.select(*groups.columns)), members.unionByName(fresh), _with_notations(notations, said, now)


def _with_notations(notations: DataFrame, said: DataFrame, now: int) -> DataFrame:
    """(name, ord, text, file, line, ts) with one more for each row of ``said``, after the last of its group."""
    for c, kind in (("file", "string"), ("line", "int")):
        said = said if c in said.columns else said.withColumn(c, F.lit(None).cast(kind))
    last = notations.groupBy("name").agg(F.max("ord").alias("__last"))
    rows = said.join(last, "name", "left").select("name", (F.coalesce("__last", F.lit(-1)) + 1).cast("int").alias("ord"), "text", "file", F.col("line").cast("int").alias("line"), F.lit(now).cast("bigint").alias("ts"))
    return notations.unionByName(rows.select(*notations.columns))


def notate(groups: DataFrame, notations: DataFrame, name: str, text: str, now: int, file: str | None = None, line: int | None = None) -> DataFrame:
    """The notations with one more of a group that exists; unchanged without such a group."""
    said = groups.where(F.col("name") == name).select("name", F.lit(text).alias("text"), F.lit(file).cast("string").alias("file"), F.lit(line).cast("int").alias("line"))
    return _with_notations(notations, said, now)


def remove_members(members: DataFrame, name: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The members less those, and (name, n) of what is left of the group."""
    spark = members.sparkSession
    gone = spark.createDataFrame([(name, p) for p in paths], "name string, path string").select("name", T.member_type(F.col("path")).alias("member_type"), T.member_path(F.col("path")).alias("path"))
    left = members.join(gone, ["name", "member_type", "path"], "left_anti")
    return left, left.where(F.col("name") == name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))


def delete_group(groups: DataFrame, members: DataFrame, notations: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col("name") != name) for df in (groups, members, notations))


def list_counts(rows: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with the number of rows that each of ``parts`` has for the key."""
    for into, df in parts.items():
        n = df.groupBy(key).agg(F.count("*").alias(into))
        rows = rows.join(n, key, "left").withColumn(into, F.coalesce(into, F.lit(0).cast("bigint")))
    return rows


# -- labels ------------------------------------------------------------------


def create_label(labels: DataFrame, name: str, now: int, emoji: str = "", description: str = "") -> DataFrame:
    """With one more label; an error where another has the name, in any case of letters."""
    if not labels.where(F.lower("name") == name.lower()).isEmpty():
        raise ValueError(f"label {name} exists")
    millis = F.lit(now).cast("bigint")
    given = {"id": T.label_id(F.lit(name), millis), "emoji": F.lit(emoji), "name": F.lit(name), "description": F.lit(description), "created_at": millis, "updated_at": millis}
    row = labels.sparkSession.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in labels.schema])
    return labels.unionByName(row)


def edit_label(labels: DataFrame, label_id: str, now: int, **changes) -> DataFrame:
    """With the label's columns changed; a name that another label has is an error."""
    if "name" in changes and not labels.where((F.col("id") != label_id) & (F.lower("name") == changes["name"].lower())).isEmpty():
        raise ValueError(f"label {changes['name']} exists")
    own = F.col("id") == label_id
    new = {c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    if "updated_at" in labels.columns:
        new["updated_at"] = F.when(own, F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))
    return labels.withColumns(new)


# -- annotations -------------------------------------------------------------


def attach(meta: DataFrame, path: str, text: str, type_: str = "note", severity: str = "info") -> DataFrame:
    """(path, ord, type, text, severity) with one more, last of its file."""
    last = meta.where(F.col("path") == path).agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).cast("int").alias("ord"))
    given = {"path": F.lit(path), "ord": F.col("ord"), "type": F.lit(type_), "text": F.lit(text), "severity": F.lit(severity)}
    return meta.unionByName(last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in meta.schema]))


def _keyed(meta: DataFrame, path: str, key: str) -> DataFrame:
    """The first note of the file whose text starts with the key and a colon."""
    return meta.where((F.col("path") == path) & (F.col("type") == "note") & F.col("text").startswith(f"{key}:")).orderBy("ord").limit(1).select("path", "ord")


def remove_annotation(meta: DataFrame, path: str, key: str) -> DataFrame:
    return meta.join(_keyed(meta, path, key), ["path", "ord"], "left_anti")


def edit_annotation(meta: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """The note of that key goes and one with the new value comes last; unchanged without such a note."""
    found = _keyed(meta, path, key)
    edited = attach(remove_annotation(meta, path, key), path, f"{key}: {value}")
    return meta if found.isEmpty() else edited


# -- small stores: macros, help topics, routines, scripts, templates, projects ----


def put(store: DataFrame, key: str, now: int | None = None, **values) -> DataFrame:
    """With one row of these values, in place of that of its key; columns not given stay as they were, or are null."""
    old = store.where(F.col(key) == values[key])
    if now is not None:
        values |= {c: now for c in ("updated_at",) if c in store.columns}
    base = store.sparkSession.range(1).select(F.lit(values[key]).alias(key)).join(old, key, "left")
    given = {c: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for c, v in values.items()}
    if now is not None and "created_at" in store.columns:
        given["created_at"] = F.coalesce("created_at", F.lit(now))
    row = base.select(*[given.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in store.schema])
    return store.where(F.col(key) != values[key]).unionByName(row)


def drop_key(store: DataFrame, key: str, value: str) -> DataFrame:
    return store.where(F.col(key) != value)


def append_text(store: DataFrame, key: str, value: str, column: str, text: str) -> DataFrame:
    """The text column of one row with a line more."""
    new = F.concat(F.coalesce(column, F.lit("")), F.when(F.coalesce(column, F.lit("")) == "", "").otherwise("\n"), F.lit(text))
    return store.withColumn(column, F.when(F.col(key) == value, new).otherwise(F.col(column)))


def replace_text(store: DataFrame, key: str, value: str, column: str, old: str, new: str) -> DataFrame:
    return store.withColumn(column, F.when(F.col(key) == value, F.replace(column, F.lit(old), F.lit(new))).otherwise(F.col(column)))


def add_to_list(store: DataFrame, key: str, value: str, column: str, item) -> DataFrame:
    """An item more in a list of one row, unless it is there."""
    have = F.coalesce(column, F.array().cast(store.schema[column].dataType))
    return store.withColumn(column, F.when(F.col(key) == value, F.array_union(have, F.array(F.lit(item)))).otherwise(F.col(column)))


def remove_from_list(store: DataFrame, key: str, value: str, column: str, item) -> DataFrame:
    return store.withColumn(column, F.when(F.col(key) == value, F.array_remove(column, item)).otherwise(F.col(column)))


def merge_metadata(metadata: DataFrame, plugin: str, more: DataFrame) -> DataFrame:
    """(path, plugin, values): what a plugin keeps on files; new values of a key go before old ones."""
    fresh = more.select("path", F.lit(plugin).alias("plugin"), F.col("values").alias("__new"))
    both = metadata.join(fresh, ["path", "plugin"], "full")
    none = F.create_map().cast("map<string,string>")
    new, old = F.coalesce("__new", none), F.coalesce("values", none)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return both.select("path", "plugin", F.map_concat(kept, new).alias("values"))


def merge_variants(metadata: DataFrame, plugin: str, more: DataFrame) -> DataFrame:
    """(path, plugin, values): as ``merge_metadata`` with values of any type, each file's an object of type VARIANT.

    New values of a key replace old ones whole; nested values keep their types. A null is no object: the other one stays.
    """
    kind = "map<string,variant>"
    fresh = more.select("path", F.lit(plugin).alias("plugin"), F.col("values").cast(kind).alias("__new"))
    both = metadata.select("path", "plugin", F.col("values").cast(kind).alias("__old")).join(fresh, ["path", "plugin"], "full")
    kept = F.map_filter("__old", lambda k, _: ~F.map_contains_key("__new", k))
    merged = F.when(F.col("__old").isNull(), F.col("__new")).when(F.col("__new").isNull(), F.col("__old")).otherwise(F.map_concat(kept, "__new"))
    return both.withColumn("m", merged).select("path", "plugin", F.expr("to_variant_object(m)").alias("values"))


def labels_by_name(labels: DataFrame, number: int, size: int, locale: str = "UNICODE_CI") -> DataFrame:
    """A page of labels in the order of a locale's collation, with their rank: accents and case part only names that are equal otherwise. Ties go by the name's code points, then by id."""
    from . import rank

    order = [F.collate("name", locale), F.col("name"), F.col("id")]
    return rank.page(labels.select("id", "name"), order, number, size).select("rank", "id", "name")
