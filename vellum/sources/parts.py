"""XML parts of packages as tables, read by Spark's own XML reader: container, relationships, styles, contents lists.

A damaged part gives no rows. rows: entries of packages (key, ix, name, data), see packages.entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions import text as T

#: Names of heading styles before their level, in the languages that writers of documents use.
HEADING_STYLES = ("heading", "título", "überschrift", "titre")
#: Levels of contents lists that are read.
MAX_DEPTH = 8


def parsed(data: Column, schema: str) -> Column:
    return F.from_xml(data.cast("string"), schema, {"ignoreNamespace": "true"})


def root_files(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, named): the package file that a book's container names first."""
    found = rows.where("lower(name) = 'meta-inf/container.xml'")
    read = parsed(F.col("data"), "rootfiles struct<rootfile:array<struct<`_full-path`:string>>>")
    return found.select(key, F.get(read["rootfiles"]["rootfile"], 0)["_full-path"].alias("named")).dropDuplicates([key])


def relations(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, part, id, target): what each part of a package refers to inside it; target is an entry's name."""
    name = F.col("name")
    found = rows.where(name.rlike(r"(?:^|/)_rels/[^/]+\.rels$"))
    folder = F.regexp_replace(F.regexp_extract(name, "^(.*?)_rels/[^/]+$", 1), "/$", "")
    owner = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.regexp_extract(name, r"_rels/([^/]+)\.rels$", 1))
    read = parsed(F.col("data"), "Relationship array<struct<_Id:string,_Target:string,_TargetMode:string>>")
    links = found.select(key, folder.alias("folder"), owner.alias("part"), F.inline(read["Relationship"]))
    inner = links.where(F.coalesce(F.col("_TargetMode"), F.lit("")) != "External")
    target = F.when(F.col("_Target").startswith("/"), F.ltrim(F.col("_Target"), F.lit("/"))).otherwise(files.normal_path(F.col("folder"), F.col("_Target")))
    return inner.select(key, "part", F.col("_Id").alias("id"), target.alias("target"))


def word_styles(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, style, level, listed): paragraph styles of Word packages that make headings (level) or list items."""
    found = rows.where("name = 'word/styles.xml'")
    read = parsed(F.col("data"), "style array<struct<_styleId:string,name:struct<_val:string>>>")
    styles = found.select(key, F.inline(read["style"])).select(key, F.col("_styleId").alias("style"), F.lower(F.trim("name._val")).alias("name"))
    digit = F.regexp_extract("name", rf"^(?:{'|'.join(HEADING_STYLES)})\s*(\d)$", 1)
    level = F.when(digit != "", digit.cast("int")).when(F.col("name") == "title", 1).when(F.col("name") == "subtitle", 2)
    return styles.select(key, "style", level.alias("level"), (level.isNull() & F.col("name").contains("list")).alias("listed")).where("level IS NOT NULL OR listed")


def core_facts(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, title, author): what a Word package says of itself; empty ones are null."""
    read = parsed(F.col("data"), "title string, creator string")
    filled = lambda c: F.when(T.trim(c) != "", T.trim(c))
    return rows.where("name = 'docProps/core.xml'").select(key, read.alias("c")).select(key, filled(F.col("c.title")).alias("title"), filled(F.col("c.creator")).alias("author"))


def contents(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, place, depth, label, target, fragment): entries of a book's NCX lists in reading order, from 0.

    target: the entry of the package that is meant; depth: from 1, at most MAX_DEPTH.
    """
    point = "_id:string"
    for _ in range(MAX_DEPTH):
        point = f"navLabel:struct<text:string>,content:struct<_src:string>,navPoint:array<struct<{point}>>"
    found = rows.where(F.lower("name").endswith(".ncx"))
    level = found.select(key, "name", F.regexp_replace("name", "/?[^/]*$", "").alias("base"), F.array().cast("array<int>").alias("way"), parsed(F.col("data"), f"navMap struct<navPoint:array<struct<{point}>>>")["navMap"]["navPoint"].alias("points"))
    seen = []
    for depth in range(1, MAX_DEPTH + 1):
        level = level.select(key, "name", "base", "way", F.posexplode("points").alias("at", "p")).withColumn("way", F.concat("way", F.array("at")))
        seen.append(level.select(key, "name", "base", "way", F.lit(depth).alias("depth"), T.collapse(F.col("p.navLabel.text")).alias("label"), F.col("p.content._src").alias("src")))
        if depth < MAX_DEPTH:
            level = level.select(key, "name", "base", "way", F.col("p.navPoint").alias("points"))
    rows = reduce(lambda a, b: a.unionByName(b), seen)
    place = F.row_number().over(Window.partitionBy(key, "name").orderBy("way")) - 1
    fragment = F.when(F.contains("src", F.lit("#")), F.split_part("src", F.lit("#"), F.lit(2)))
    return rows.select(key, "name", place.alias("place"), "depth", "label", files.normal_path(F.col("base"), F.col("src")).alias("target"), fragment.alias("fragment"))
