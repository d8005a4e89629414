"""Assets: an index of media files, and resolving what scripts show and play."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut, numbered

VISUAL = ("scene", "show", "image")
#: Names that need no file.
BUILTIN = ("black", "white", "none", "transparent")
#: Displayables made in place.
MADE = ("Solid", "Composite", "Transform", "Frame")
MOST = 1000
#: Rounds of looking up a name behind a name.
HOPS = 4


def clean_asset(asset: Column) -> Column:
    """Without quotes, ``<...>`` audio tags, a leading ``expression`` and a trailing ``with ...``."""
    a = F.regexp_replace(F.trim(asset), r"^expression\s+", "")
    a = F.regexp_replace(a, r"<[^>]*>", "")
    a = F.regexp_replace(a, r"\s+with\s+.*$", "")
    return F.trim(F.regexp_replace(a, r'^["\x27]|["\x27]$', ""))


def normal_path(path: Column) -> Column:
    """With forward slashes, without a leading ``./`` and then ``game/``."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    return F.trim(F.regexp_replace(p, r"(?i)^game/", ""))


def needs_no_file(name: Column) -> Column:
    """Built-in displayables, those made in place, and colours of 3, 4, 6 or 8 digits."""
    n = F.trim(name)
    return F.lower(n).isin(*BUILTIN) | n.rlike(rf"(?i)^({'|'.join(MADE)})\s*\(") | n.rlike(r"^#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")


def media_index(media: DataFrame) -> DataFrame:
    """One row per key of a file: project_id, kind, key, path, priority; a later file wins a key.

    Kinds in order: exact, lower, file (name), stem, relative (path without extension), audio
    (``audio.name``), tag (image names: stem, with spaces for ``_`` or ``/``, both).
    """
    path = normal_path(F.col("path"))
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    relative = F.regexp_replace(path, r"\.[^.]+$", "")
    inner = F.regexp_replace(F.lower(relative), r"^(game/)?images/", "")
    audio = F.lower(path).rlike(r"\.(ogg|mp3|wav|opus|flac)$")
    keys = [
        ("exact", path), ("lower", F.lower(path)), ("file", F.lower(name)), ("stem", F.lower(stem)), ("relative", F.lower(relative)),
        ("audio", F.when(audio, F.concat(F.lit("audio."), F.lower(stem)))), ("tag", F.lower(stem)), ("tag", F.replace(F.lower(stem), F.lit("_"), F.lit(" "))),
        ("tag", F.replace(inner, F.lit("/"), F.lit(" "))), ("tag", F.replace(F.replace(inner, F.lit("/"), F.lit(" ")), F.lit("_"), F.lit(" "))),
    ]
    order = list(dict.fromkeys(k for k, _ in keys))
    # files are few bytes and many keys: they are dealt before their keys are told
    parts = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    media = media.select("project_id", "path", "ord").repartition(parts, "project_id", "path")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(order.index(k)).alias("priority"), v.alias("key")) for k, v in keys]))
    rows = media.select("project_id", path.alias("path"), "ord", each.alias("k")).select("project_id", "path", "ord", "k.*").where("key is not null")
    return rows.groupBy("project_id", "kind", "priority", "key").agg(F.max_by("path", "ord").alias("path"))


def resolve(names: DataFrame, index: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Distinct (project_id, type, name) with their path, null if there is none.

    ``definitions`` (project_id, key, value): image and variable names that stand for others,
    followed up to ``HOPS`` times.
    """
    names = cut(names.select("project_id", "type", "name").distinct().withColumn("at", F.col("name")))
    found = []
    for hop in range(HOPS + 1):
        exact = _match(names, index)
        hit = exact.groupBy("project_id", "type", "name").agg(F.min_by("path", "priority").alias("path"))
        found.append(hit)
        if definitions is None or hop == HOPS:
            break
        left = names.join(hit, ["project_id", "type", "name"], "left_anti")
        names = cut(left.join(definitions.select("project_id", F.col("key").alias("at"), "value"), ["project_id", "at"]).select("project_id", "type", "name", clean_asset(F.col("value")).alias("at")))
        if names.isEmpty():
            break
    return reduce(DataFrame.unionAll, found)


def _match(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Names against the keys of the index: as written, and in lower case."""
    at = normal_path(F.col("at"))
    own = asked.select("project_id", "type", "name", F.explode(F.array(F.struct(F.lit(True).alias("own"), at.alias("key")), F.struct(F.lit(False).alias("own"), F.lower(at).alias("key")))).alias("x")).select("project_id", "type", "name", "x.*").distinct()
    m = own.join(index.hint("merge"), ["project_id", "key"]).where("own = (kind = 'exact')")
    return m.where(F.when(F.col("kind") == "audio", ~F.col("type").isin(*VISUAL)).when(F.col("kind") == "tag", F.col("type").isin(*VISUAL)).otherwise(True))


def split_playlists(cues: DataFrame) -> DataFrame:
    """Cues with ``name``, one row per item of a ``[a, b]`` list."""
    items = F.when(F.col("asset").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract_all("asset", F.lit(r'["\x27]([^"\x27]+)["\x27]'), F.lit(1))).otherwise(F.array("asset"))
    return cues.withColumn("name", F.explode(items)).withColumn("name", clean_asset(F.col("name"))).where("name <> ''")


def missing_assets(cues: DataFrame, media: DataFrame, definitions: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Cues without a file: project_id, type, name, n, and a ``missing_asset`` diagnostic each,
    ``most`` a project; projects without any media are left out."""
    known = media.select("project_id").distinct()
    asked = split_playlists(cues).join(known, "project_id", "left_semi").where(~needs_no_file(F.col("name")))
    totals = asked.groupBy("project_id", "type", "name").agg(F.count("*").alias("n"))
    hit = resolve(totals, media_index(media), definitions)
    gone = totals.join(hit, ["project_id", "type", "name"], "left_anti")
    return numbered(gone, ["project_id"], ["type", "name"], "__nth").where(F.col("__nth") <= most).select("project_id", "type", "name", "n", F.lit("missing_asset").alias("category"))


def catalog(cues: DataFrame) -> DataFrame:
    """Distinct assets with the nodes that use them: scene, image (show) or audio."""
    kind = F.when(F.col("type") == "scene", "scene").when(F.col("type").isin("show", "image"), "image").otherwise("audio")
    return split_playlists(cues).groupBy("project_id", kind.alias("type"), "name").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
