"""Markdown notes on disk: scan, header parsing, and the sinks that create, change and delete notes."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import path_parts, strip
from ..plans.ordering import numbered

_LIST = {"tags": ("tag", "tags"), "aliases": ("alias", "aliases")}


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes below ``root`` in the archive's note schema. ``id`` counts from 0 in order of the relative path."""
    base = "file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base.rstrip("/") + "/_*")
    found = hidden.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hidden)
    # Spark's listing skips names with a leading underscore unless they are named as roots
    roots = [root, *[str(x.getPath()) for x in found if x.isDirectory()]]
    raw = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    tail = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^" + re.escape(base.rstrip("/")).replace("file:", "file:/*") + "/", "")
    d = parse_notes(raw.withColumn("relative_path", F.regexp_replace(tail, "^file:/*" + re.escape(os.path.abspath(root).lstrip("/")) + "/", "")))
    return numbered(d, "id", "relative_path")


def parse_notes(files: DataFrame) -> DataFrame:
    """(text, relative_path) to notes: header lines ``key: value`` up to the first blank line or line without a colon.

    title, tag(s) and alias(es) are special, other keys go to meta; of repeated keys the last wins.
    """
    lines = F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n")
    d = files.withColumn("_l", lines)
    ends = F.filter(F.transform("_l", lambda x, i: F.when((strip(x) == "") | ~F.contains(x, F.lit(":")), i)), lambda i: i.isNotNull())
    d = d.withColumn("_n", F.coalesce(F.get(ends, F.lit(0)), F.size("_l")))
    head = F.slice("_l", F.lit(1), F.col("_n"))
    pair = lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    d = d.withColumn("_h", F.map_from_entries(F.transform(head, pair)))
    blank = strip(F.coalesce(F.get("_l", F.col("_n")), F.lit("x"))) == ""
    rest = F.slice("_l", F.col("_n") + F.when(blank, 2).otherwise(1), F.greatest(F.size("_l") - F.col("_n"), F.lit(0)))
    body = strip(F.array_join(F.transform(rest, strip), "\n"))
    split = lambda c: F.filter(F.transform(F.split(F.lower(c), ","), strip), lambda x: x != "")
    value = lambda names: F.coalesce(*[F.try_element_at("_h", F.lit(n)) for n in names], F.lit(""))
    special = ["title", *_LIST["tags"], *_LIST["aliases"]]
    meta = F.map_filter("_h", lambda k, v: ~k.isin(special))
    category = F.regexp_replace(F.regexp_replace("relative_path", "[^/]*$", ""), "/$", "")
    name = F.regexp_replace(F.regexp_replace("relative_path", "^.*/", ""), "\\.md$", "")
    d = d.select(
        F.try_element_at("_h", F.lit("note_id")).alias("note_id"), F.coalesce(F.try_element_at("_h", F.lit("title")), name).alias("title"),
        split(value(_LIST["tags"])).alias("tags"), split(value(_LIST["aliases"])).alias("aliases"), meta.alias("meta"),
        F.try_element_at("_h", F.lit("source_doc_id")).alias("source_doc_id"), body.alias("body"), "relative_path", category.alias("category"),
    )
    parts = path_parts(F.col("category"))
    d = d.withColumn("category_parts", parts).withColumn("is_generated", F.coalesce(F.get("category_parts", F.lit(0)) == "_generated", F.lit(False)))
    return d.withColumn("note_origin", P.note_origin(F.col("is_generated"), F.col("category_parts")))


def header_text(title: Column, tags: Column, aliases: Column, meta: Column) -> Column:
    """The header of a note file; aliases are distinct and in lower case."""
    low = F.array_distinct(F.transform(aliases, F.lower))
    rest = F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("tags: "), F.array_join(tags, ", ")), F.concat(F.lit("aliases: "), F.array_join(low, ", ")), F.when(rest != "", rest))


def note_text(notes: DataFrame) -> DataFrame:
    """(relative_path, text): notes as files."""
    none = F.array().cast("array<string>")
    h = header_text(F.coalesce("title", F.lit("")), F.coalesce("tags", none), F.coalesce("aliases", none), F.coalesce("meta", F.create_map().cast("map<string,string>")))
    return notes.select("relative_path", F.concat(h, F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def safe_parts(category: str) -> list[str]:
    """Folder names of a category; absolute, hidden and climbing paths are errors."""
    parts = [p for p in category.replace("\\", "/").split("/") if p]
    if category.startswith(("/", "\\")) or not parts or any(p in (".", "..") or p.startswith((".", "_")) or not re.fullmatch(r"[\w -]+", p) for p in parts):
        raise ValueError(f"unsafe category {category!r}")
    return parts


def _inside(root: str, relative: str) -> str:
    full = os.path.realpath(os.path.join(root, relative))
    base = os.path.realpath(root)
    if os.path.commonpath([full, base]) != base or os.path.relpath(full, base).split(os.sep)[0] == "_generated":
        raise ValueError(f"{relative!r} is not a note that may be changed")
    return full


def create_note(root: str, title: str, tags: list[str], body: str, category: str, aliases: list[str] | None = None) -> str:
    """Write a new note and return its relative path; an existing file is an error, never overwritten."""
    parts = safe_parts(category)
    name = re.sub("_+", "_", re.sub(r"[^a-z0-9_-]", "", title.lower().replace(" ", "_"))).strip("_") or "untitled_note"
    folder = os.path.join(root, *parts)
    os.makedirs(folder, exist_ok=True)
    relative = "/".join([*parts, f"{name}.md"])
    low = list(dict.fromkeys(a.lower() for a in aliases or []))
    head = [f"title: {title}", f"note_id: note_{uuid.uuid4().hex[:12]}", f"tags: {', '.join(tags)}", f"aliases: {', '.join(low)}"]
    with open(_inside(root, relative), "x", encoding="utf-8") as f:
        f.write("\n".join(head) + "\n\n" + body + "\n")
    return relative


def update_note(root: str, relative: str, title: str, tags: list[str], body: str, aliases: list[str] | None = None) -> None:
    """Rewrite a note; header keys other than title, tags and aliases stay as they are."""
    path = _inside(root, relative)
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    kept = []
    for line in lines:
        if not line.strip() or ":" not in line:
            break
        if line.split(":", 1)[0].strip().lower() not in ("title", "tag", "tags", "alias", "aliases"):
            kept.append(line)
    low = list(dict.fromkeys(a.lower() for a in aliases or []))
    head = [f"title: {title}", *kept, f"tags: {', '.join(tags)}", f"aliases: {', '.join(low)}"]
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as f:
        f.write("\n".join(head) + "\n\n" + body + "\n")
    os.replace(part, path)


def delete_note(root: str, relative: str) -> None:
    os.remove(_inside(root, relative))
