"""Folder trees by materialised path: labels joined by dots, a folder's subtree being a path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folder_label


def in_subtree(path: Column, root: str) -> Column:
    """The folder itself and all below it."""
    return (path == root) | path.startswith(root + ".")


def ancestor_paths(path: Column) -> Column:
    labels = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))


def pre_order(df: DataFrame) -> DataFrame:
    """Tree order: by label arrays, so that a parent comes just before its children whatever their letters."""
    return df.orderBy(F.split("path", r"\."))


def with_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds document_count (in the folder) and subtree_count (in it or below), by equi-joins on exploded ancestors."""
    own = docs.where("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("n"))
    per = folders.join(own, "folder_id", "left").withColumn("document_count", F.coalesce("n", F.lit(0))).drop("n")
    below = per.select(F.explode(ancestor_paths(F.col("path"))).alias("path"), "document_count").groupBy("path").agg(F.sum("document_count").alias("subtree_count"))
    return per.join(below, "path", "left")


def children(folders: DataFrame, parent_id: int | None) -> DataFrame:
    """Direct children (null: the roots) with whether they have children themselves."""
    parents = folders.where("parent_id is not null").select(F.col("parent_id").alias("folder_id"), F.lit(True).alias("has")).distinct()
    return folders.where(F.col("parent_id").eqNullSafe(F.lit(parent_id).cast("bigint"))).join(parents, "folder_id", "left").withColumn("has_children", F.coalesce("has", F.lit(False))).drop("has")


def unfiled(docs: DataFrame, limit: int = 500) -> DataFrame:
    return docs.where("folder_id is null").orderBy("doc_id").limit(limit)


def find_document(docs: DataFrame, folder_id: int | None, filename: str) -> DataFrame:
    """The first document of a name in a folder, or outside all folders."""
    return docs.where(F.col("folder_id").eqNullSafe(F.lit(folder_id).cast("bigint")) & (F.col("filename") == filename)).orderBy("doc_id").limit(1)


def ensure_paths(wanted: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """path, name, parent_path of every folder that slash paths need and that isn't there."""
    names = F.filter(F.split(path, "/"), lambda x: F.trim(x) != "")
    steps = wanted.select(names.alias("names")).select("names", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("k")).where("size(names) > 0")
    labelled = steps.select(F.slice("names", 1, F.col("k")).alias("trail")).distinct()
    parts = labelled.select("trail", F.posexplode("trail").alias("i", "name")).withColumn("label", folder_label(F.col("name")))
    ordered = F.array_sort(F.collect_list(F.struct("i", "label")))
    made = parts.groupBy("trail").agg(F.transform(ordered, lambda x: x["label"]).alias("labels"))
    rows = made.select(F.array_join("labels", ".").alias("path"), F.element_at("trail", -1).alias("name"), F.array_join(F.slice("labels", 1, F.size("labels") - 1), ".").alias("parent_path"))
    return rows.groupBy("path").agg(F.min("name").alias("name"), F.min("parent_path").alias("parent_path")).join(folders.select("path"), "path", "left_anti")


def numbered_labels(new: DataFrame) -> DataFrame:
    """parent_path, name, label with suffixes _2, _3 ... for equal labels under one parent."""
    nth = F.row_number().over(W.partitionBy("parent_path", "label").orderBy("created_at", "name"))
    return new.withColumn("n", nth).withColumn("label", F.when(F.col("n") > 1, F.concat("label", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("label"))).drop("n")


def move_subtree(folders: DataFrame, old: str, new: str) -> DataFrame:
    """All paths with the prefix rewritten; moving a folder into itself is refused."""
    if new == old or new.startswith(old + "."):
        raise ValueError("a folder can't move into itself")
    return folders.withColumn("path", F.when(in_subtree(F.col("path"), old), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path")))


def delete_subtree(folders: DataFrame, docs: DataFrame, root: str) -> DataFrame:
    """The folders without a subtree; refused while a document lies in it."""
    inside = folders.where(in_subtree(F.col("path"), root))
    if not docs.join(inside, "folder_id", "left_semi").isEmpty():
        raise ValueError("documents remain in the subtree")
    return folders.where(~in_subtree(F.col("path"), root))


def atlas_index(counted: DataFrame) -> DataFrame:
    """One Markdown index of all folders in tree order; a folder tree is small next to its documents."""
    depth = F.size(F.split("path", r"\.")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.when(depth == 0, "##").otherwise("-"), F.lit(" "), F.col("name"), F.lit(" — _documents: "), F.col("document_count").cast("string"), F.lit("_"))
    noted = F.when(F.coalesce("description", F.lit("")) != "", F.concat(line, F.lit("\n"), F.repeat(F.lit("  "), depth), F.lit("  "), F.col("description"))).otherwise(line)
    lines = F.array_sort(F.collect_list(F.struct(F.split("path", r"\.").alias("p"), noted.alias("line"))))
    return counted.agg(F.concat(F.lit("# Knowledge base Atlas\n\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def atlas_nodes(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """folder_id, markdown: each folder with its documents (title, summary, section_count), without a model."""
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("** — "), F.coalesce("summary", F.lit("")), F.lit(" ("), F.coalesce("section_count", F.lit(0)).cast("string"), F.lit(" sections)"))
    per = docs.groupBy("folder_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.concat_ws("\n", F.concat(F.lit("## "), F.col("name")), F.when(F.coalesce("description", F.lit("")) != "", F.col("description")), F.col("lines"))
    return folders.join(per, "folder_id", "left").select("folder_id", F.concat(text, F.lit("\n")).alias("markdown"))


def rename(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: folder_id and any of name, description, one row a folder; null leaves a field as it is. Paths stay."""
    fields = [c for c in ("name", "description") if c in requests.columns]
    new = requests.select("folder_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    return folders.join(new, "folder_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).select(*folders.columns)


def atlas_pages(folders: DataFrame, docs: DataFrame, changed: DataFrame) -> DataFrame:
    """scope, content_md: the nodes of changed folders (folder_id) and the index of all."""
    touched = folders.join(changed.select("folder_id").distinct(), "folder_id", "left_semi")
    nodes = atlas_nodes(touched, docs.join(touched.select("folder_id"), "folder_id", "left_semi"))
    index = atlas_index(with_counts(folders, docs)).select(F.lit("index").alias("scope"), F.col("markdown").alias("content_md"))
    return nodes.select(F.concat(F.lit("folder:"), F.col("folder_id").cast("string")).alias("scope"), F.col("markdown").alias("content_md")).unionByName(index)


def put_atlas(atlas: DataFrame, pages: DataFrame) -> DataFrame:
    """The atlas (scope, content_md, version) with pages (scope, content_md) put in: a known scope gets the next version, a new one 1."""
    new = pages.select("scope", F.col("content_md").alias("new"), F.lit(True).alias("hit"))
    both = atlas.join(new, "scope", "full_outer")
    step = F.when(F.col("hit"), 1).otherwise(0)
    return both.select("scope", F.when(F.col("hit"), F.col("new")).otherwise(F.col("content_md")).alias("content_md"), (F.coalesce("version", F.lit(0)) + step).cast("bigint").alias("version"))


def atlas_tree(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """path, depth, name, titles: the nested tree as flat rows; unfiled documents under a null path."""
    titles = docs.groupBy("folder_id").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    filed = folders.join(titles, "folder_id", "left").select("path", (F.size(F.split("path", r"\.")) - 1).alias("depth"), "name", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    loose = titles.where("folder_id is null").select(F.lit(None).cast("string").alias("path"), F.lit(0).alias("depth"), F.lit("(unfiled)").alias("name"), "titles")
    return filed.unionByName(loose)
