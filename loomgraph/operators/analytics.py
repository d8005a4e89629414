"""Narrative analytics: metrics, endings, points of no return, pacing, speakers, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut, numbered
from loomgraph.functions.text import ending_type, format_minutes, pause_seconds, reading_seconds, word_count
from loomgraph.plans.frontier import BITS, WORDS, live, present

FORWARD = ("sequence", "jump", "call", "call_return")


def node_metrics(lines: DataFrame) -> DataFrame:
    """Say lines (node_id, speaker, line_no, text) to nodes: counts, ordered lines, speakers."""
    said = lines.withColumn("words", word_count(F.col("text"))).withColumn("speaker", F.coalesce("speaker", F.lit("narrator")))
    by_node = said.groupBy("project_id", "node_id").agg(
        F.count("*").alias("dialogue_count"), F.sum("words").alias("word_count"), F.sum(pause_seconds(F.col("text"))).alias("pause_duration"),
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("__lines"),
    )
    by_speaker = said.groupBy("project_id", "node_id", "speaker").agg(F.count("*").alias("line_count"), F.sum("words").alias("word_count"))
    maps = by_speaker.groupBy("project_id", "node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker", F.struct("line_count", "word_count"))))).alias("character_dialogue"))
    return by_node.join(maps, ["project_id", "node_id"]).select(
        "project_id", "node_id", "dialogue_count", "word_count", "pause_duration",
        F.transform("__lines", lambda x: x["text"]).alias("dialogue_lines"), F.transform("__lines", lambda x: x["line_no"]).alias("dialogue_line_nums"), "character_dialogue",
    )


def chapter_aggregates(nodes: DataFrame) -> DataFrame:
    """Sums by chapter; null or empty: Uncategorized."""
    chapter = F.when(present(F.col("chapter")), F.col("chapter")).otherwise("Uncategorized")
    count = lambda t: F.count_if(F.col("type") == t)
    return nodes.groupBy("project_id", chapter.alias("chapter")).agg(
        F.count("*").alias("node_count"), F.sum("dialogue_count").cast("long").alias("dialogue_count"), F.sum("word_count").cast("long").alias("word_count"),
        F.sum("pause_duration").alias("pause_duration"), count("LABEL").alias("label_count"), count("MENU").alias("menu_count"), count("DECISION").alias("decision_count"),
    )


def choice_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live edges from a menu or with a label, by chapter of their source ('' counts as none)."""
    src = nodes.select("project_id", F.col("id").alias("source"), F.col("type").alias("t"), F.when(present(F.col("chapter")), F.col("chapter")).otherwise("Uncategorized").alias("chapter"))
    e = live(edges).join(src, ["project_id", "source"]).where((F.col("t") == "MENU") | present(F.col("label")))
    return e.groupBy("project_id", "chapter").agg(F.count("*").alias("choice_count"))


def chapter_pacing(nodes: DataFrame, edges: DataFrame, monologues: DataFrame | None = None, wpm: float = 200.0) -> DataFrame:
    """Lines, words, menus, choices, lines per menu, reading time and longest monologue by chapter."""
    by = nodes.groupBy("project_id", F.coalesce("chapter", F.lit("Uncategorized")).alias("chapter")).agg(
        F.sum("dialogue_count").cast("long").alias("lines"), F.sum("word_count").cast("long").alias("words"), F.sum("pause_duration").alias("pause"), F.count_if(F.col("type") == "MENU").alias("menus"),
    )
    out = by.join(choice_counts(nodes, edges), ["project_id", "chapter"], "left")
    seconds = reading_seconds(F.col("words"), F.col("pause"), wpm)
    out = out.select(
        "project_id", "chapter", "lines", "words", "menus", F.coalesce("choice_count", F.lit(0)).cast("long").alias("choices"),
        F.when(F.col("menus") > 0, F.round(F.col("lines") / F.col("menus"), 1)).otherwise(F.col("lines").cast("double")).alias("lines_per_menu"),
        seconds.alias("reading_seconds"), format_minutes(seconds).alias("reading_time"),
    )
    if monologues is None:
        return out
    longest = monologues.groupBy("project_id", "chapter").agg(F.count("*").alias("monologues"), F.max("lines").alias("longest_lines"), F.max("words").alias("longest_words"))
    zero = F.lit(0)
    return out.join(longest, ["project_id", "chapter"], "left").select(out["*"], *[F.coalesce(c, zero).cast("long").alias(c) for c in ("monologues", "longest_lines", "longest_words")])


def character_distribution(lines: DataFrame) -> DataFrame:
    """Lines, words and shares of all words and of all lines by speaker, most words first; null: narrator."""
    by = lines.groupBy("project_id", F.coalesce("speaker", F.lit("narrator")).alias("speaker")).agg(F.count("*").alias("line_count"), F.sum(word_count(F.col("text"))).cast("long").alias("word_count"))
    total = by.groupBy("project_id").agg(F.sum("word_count").alias("total"), F.sum("line_count").alias("lines"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) * 100.0 / F.col(whole), 1)).otherwise(0.0)
    return by.join(total, "project_id").select("project_id", "speaker", "line_count", "word_count", share("word_count", "total").alias("percent"), share("line_count", "lines").alias("line_percent")).orderBy(F.desc("word_count"), F.desc("line_count"), "speaker")


def terminal_endings(nodes: DataFrame, edges: DataFrame, tags: DataFrame | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Endings: marked terminal, or story nodes without a live sequence, jump, call or call_return
    edge out. ``tags`` (project_id, id, ending_type) go before the rules."""
    onward = live(edges).where(F.col("kind").isin(*FORWARD)).select("project_id", F.col("source").alias("id")).distinct()
    stops = nodes.join(onward, ["project_id", "id"], "left_anti").where("role = 'story'").select("project_id", "id")
    marked = nodes.where("is_terminal_outcome").select("project_id", "id")
    ends = nodes.where("not coalesce(is_shadowed, false)").join(stops.unionAll(marked).distinct(), ["project_id", "id"], "left_semi")
    lines = F.col("dialogue_lines") if "dialogue_lines" in nodes.columns else F.array().cast("array<string>")
    orphan = F.coalesce("is_orphan", F.lit(False)) if "is_orphan" in nodes.columns else F.lit(False)
    kind = ending_type(F.col("label"), lines, F.col("dialogue_count"), rules)
    if tags is not None:
        ends = ends.join(tags.select("project_id", "id", F.col("ending_type").alias("__tag")), ["project_id", "id"], "left")
        kind = F.coalesce("__tag", kind)
    return ends.select(
        "project_id", F.col("id").alias("node_id"), F.when(present(F.col("label")), F.col("label")).otherwise(F.col("id")).alias("label"), "chapter",
        kind.alias("ending_type"), orphan.alias("is_orphan"), "word_count", "pause_duration", "dialogue_count",
    )


def points_of_no_return(edges: DataFrame, nodes: DataFrame, reach: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """Choices (from a menu or decision, or with a label or condition) that lose endings.

    ``reach``: project_id, node, ending; or project_id, node, ends, as ``frontier.reach_sets`` gives them; or what ``frontier.reach_bits`` gives: then endings come to the choices as bits, and names
    are told where the rows are given on, so that no list of them is shuffled. A lock-in leaves exactly one ending.
    """
    types = nodes.select("project_id", F.col("id").alias("source"), F.col("type").alias("t"))
    known = nodes.select("project_id", F.col("id").alias("target"))
    cond = F.col("expression").isNotNull() if "expression" in edges.columns else F.lit(False)
    e = live(edges).join(types, ["project_id", "source"]).join(known, ["project_id", "target"], "left_semi").where(F.col("t").isin("MENU", "DECISION") | present(F.col("label")) | cond)
    both = lambda sets, c: e.join(sets.select("project_id", F.col("node").alias("source"), F.col(c).alias("prior")), ["project_id", "source"]).join(sets.select("project_id", F.col("node").alias("target"), F.col(c).alias("rest")), ["project_id", "target"], "left")
    if isinstance(reach, tuple):
        found, ends = reach
        e = e.select("project_id", "edge_ord", "id", "source", "target")
        sets = cut(found.groupBy("project_id", "node").agg(F.collect_list(F.struct("block", F.array(*WORDS).alias("words"))).alias("bits")))
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = both(sets, "bits").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumns({"block": F.lit(None).cast("long"), "names": F.lit(None).cast("array<struct<at:int,ending:string>>")})
        # each bucket has the names of its project's endings
        names = ends.groupBy("project_id", "block").agg(F.collect_list(F.struct((F.col("word") * BITS + F.col("bit")).alias("at"), "ending")).alias("names"))
        names = names.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = names.unionByName(rows, allowMissingColumns=True).select("project_id", "bucket", "edge_ord", "id", "source", "target", "prior", "rest", "block", "names")
        dealt = dealt.repartition("project_id", "bucket").sortWithinPartitions("project_id", "bucket", F.asc_nulls_first("id"), "edge_ord")
        return dealt.mapInArrow(_lost, LOST)
    sets = cut(reach if "ends" in reach.columns else reach.groupBy("project_id", "node").agg(F.array_sort(F.collect_set("ending")).alias("ends")))
    w = Window.partitionBy("project_id", "id").orderBy("edge_ord")
    e = both(sets, "ends")
    rest = F.coalesce("rest", F.array().cast("array<string>"))
    lost = F.array_except("prior", rest)
    e = e.where((F.size("prior") > 1) & (F.size(lost) > 0)).withColumn("__nth", F.row_number().over(w)).where("__nth = 1")
    return e.select("project_id", F.col("id").alias("edge_id"), "source", "target", "prior", rest.alias("remaining"), F.array_sort(lost).alias("eliminated"), (F.size(rest) == 1).alias("is_lock_in"))


LOST = "project_id string, edge_id string, source string, target string, prior array<string>, remaining array<string>, eliminated array<string>, is_lock_in boolean"
#: Rows of bits that are given names together.
AT_ONCE = 4096


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for the bits of choices: of each bucket first its endings, then its choices by id, the first of an id that counts."""
    key, names, last = None, [], None
    size = BITS * len(WORDS)
    for batch in batches:
        keys = list(zip(batch.column("project_id").to_pylist(), batch.column("bucket").to_pylist()))
        told = batch.column("names").is_valid().to_numpy(zero_copy_only=False)
        s = 0
        while s < len(keys):
            if keys[s] != key:
                key, names, table, last = keys[s], [], None, None
            e = s + 1
            while e < len(keys) and keys[e] == key and told[e] == told[s]:
                e += 1
            rows, s = batch.slice(s, e - s), e
            if rows.column("names")[0].is_valid:
                names.append(rows.select(["block", "names"]))
                continue
            if table is None:
                table = _table(names, size)
            for k in _pieces(rows):
                out, last = _told(k, table, size, last)
                yield out


def _table(names: list[pa.RecordBatch], size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The blocks, the rank of each of their places by name, and all names in order."""
    every = pa.Table.from_batches(names).combine_chunks()
    blocks = every["block"].to_numpy()
    order = np.sort(blocks)
    listed = every["names"].combine_chunks()
    flat = pc.list_flatten(listed)
    at = np.repeat(np.searchsorted(order, blocks), pc.list_value_length(listed).to_numpy()) * size + pc.struct_field(flat, "at").to_numpy()
    endings = pc.struct_field(flat, "ending")
    by = pc.sort_indices(endings).to_numpy()
    rank = np.zeros(len(order) * size, dtype=np.int64)
    rank[at[by]] = np.arange(len(by))
    return order, rank, endings.take(pa.array(by))


def _pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``rows`` in pieces of about ``AT_ONCE`` blocks."""
    upto, s = np.cumsum(pc.list_value_length(rows.column("prior")).to_numpy()), 0
    while s < rows.num_rows:
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + AT_ONCE)))
        yield rows.slice(s, e - s)
        s = e


def _told(rows: pa.RecordBatch, table: tuple[np.ndarray, np.ndarray, pa.Array], size: int, last: str | None) -> tuple[pa.RecordBatch, str | None]:
    order, rank, names = table
    n = rows.num_rows

    def bits(c: str) -> tuple[np.ndarray, np.ndarray]:
        lists = rows.column(c)
        flat = pc.list_flatten(lists)
        of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        place = of * len(order) + np.searchsorted(order, pc.struct_field(flat, "block").to_numpy())
        words = pc.list_flatten(pc.struct_field(flat, "words")).to_numpy().reshape(-1, len(WORDS))
        by = np.argsort(place, kind="stable")
        return place[by], words[by]

    def ranks(place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row how many endings it has, and these by name."""
        k, at = np.nonzero(np.unpackbits(np.ascontiguousarray(words, dtype="<i8").view(np.uint8), axis=1, bitorder="little"))
        of = place[k] // len(order)
        by = np.sort(of * len(names) + rank[place[k] % len(order) * size + at], kind="stable")
        return np.bincount(of, minlength=n), by

    prior, rest = bits("prior"), bits("rest")
    lost = prior[1].copy()
    if len(rest[0]):
        at = np.minimum(np.searchsorted(rest[0], prior[0]), len(rest[0]) - 1)
        lost[rest[0][at] == prior[0]] &= ~rest[1][at][rest[0][at] == prior[0]]
    sets = [ranks(*prior), ranks(*rest), ranks(prior[0], lost)]
    counts = (sets[0][0] > 1) & (sets[2][0] > 0)
    ids = rows.column("id").to_pylist()
    for i in np.flatnonzero(counts).tolist():
        if ids[i] == last:
            counts[i] = False
        last = ids[i]
    lists = []
    for many, by in sets:
        kept = by[counts[by // len(names)]] % len(names) if len(by) else by
        lists.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many[counts]))).astype(np.int32), names.take(pa.array(kept))))
    own = [rows.column(c).filter(pa.array(counts)) for c in ("project_id", "id", "source", "target")]
    return pa.RecordBatch.from_arrays([*own, *lists, pa.array(sets[1][0][counts] == 1)], names=[c.split()[0] for c in LOST.split(", ")]), last


def ending_matrix(endings: DataFrame, routes: DataFrame) -> DataFrame:
    """Endings with the number of routes that reach them, reachable ones first."""
    n = routes.groupBy("project_id", F.col("ending").alias("node_id")).agg(F.count("*").alias("routes"))
    j = endings.join(n, ["project_id", "node_id"], "left")
    return j.select("project_id", "node_id", "label", "chapter", "ending_type", F.coalesce("routes", F.lit(0)).cast("long").alias("routes"), "word_count", "pause_duration", "dialogue_count", F.when(F.col("is_orphan"), "Unreachable").otherwise("Reachable").alias("status")).orderBy("is_orphan", "node_id")


def narrative_summary(nodes: DataFrame, edges: DataFrame, endings: DataFrame, routes: DataFrame, no_return: DataFrame, wpm: float = 200.0) -> DataFrame:
    """One row per project over the nodes that aren't orphans; routes: ending, words, pause, route_ord. ``truncated``: the list of routes was cut."""
    orphan = F.coalesce("is_orphan", F.lit(False)) if "is_orphan" in nodes.columns else F.lit(False)
    per = nodes.groupBy("project_id").agg(
        F.sum(F.when(~orphan, F.col("dialogue_count"))).alias("lines"), F.coalesce(F.sum(F.when(~orphan, F.col("word_count"))), F.lit(0)).cast("long").alias("unique_words"),
        F.coalesce(F.sum(F.when(~orphan, F.col("pause_duration"))), F.lit(0.0)).alias("pause"), F.count_if((F.col("type") == "MENU") & ~orphan).alias("menus"),
    )
    timed = routes.withColumn("seconds", reading_seconds(F.col("words"), F.col("pause"), wpm))
    r = timed.groupBy("project_id").agg(F.count("*").alias("routes"), F.min_by("ending", F.struct("seconds", "route_ord")).alias("shortest"), F.max_by("ending", F.struct("seconds", -F.col("route_ord"))).alias("longest"), F.avg("seconds").alias("average_seconds"),
        *[f(c, F.struct("seconds", sign * F.col("route_ord"))).alias(f"{which}_{c}") for which, f, sign in (("shortest", F.min_by, 1), ("longest", F.max_by, -1)) for c in ("seconds", "words")],
        (F.max("truncated") if "truncated" in routes.columns else F.lit(False)).alias("truncated"))
    ends = endings.groupBy("project_id").agg(F.count("*").alias("endings"))
    points = no_return.groupBy("project_id").agg(F.count("*").alias("points_of_no_return"))
    choices = choice_counts(nodes, edges).groupBy("project_id").agg(F.sum("choice_count").alias("choices"))
    j = per
    for other in (r, ends, points, choices):
        j = j.join(other, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select(
        "project_id", zero("endings"), zero("routes"), "shortest", "longest", F.coalesce("average_seconds", F.lit(0.0)).alias("average_seconds"), zero("points_of_no_return"), "unique_words",
        reading_seconds(F.col("unique_words"), F.col("pause"), wpm).alias("unique_seconds"),
        F.when(F.col("menus") > 0, F.round(F.col("lines") / F.col("menus"), 1)).otherwise(F.coalesce("lines", F.lit(0)).cast("double")).alias("lines_per_menu"),
        F.when(F.col("menus") > 0, F.round(F.coalesce("choices", F.lit(0)) / F.col("menus"), 2)).otherwise(F.coalesce("choices", F.lit(0)).cast("double")).alias("choices_per_menu"),
        "shortest_seconds", "shortest_words", "longest_seconds", "longest_words", F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Counts of nodes, edges and warnings, and the sorted codes of warnings."""
    n = nodes.groupBy("project_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("project_id").agg(F.count("*").alias("edges"))
    d = diagnostics.groupBy("project_id").agg(F.count("*").alias("warnings"), F.array_sort(F.collect_set("category")).alias("codes"))
    j = n.join(e, "project_id", "left").join(d, "project_id", "left")
    return j.select("project_id", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def diagnostics_report(diagnostics: DataFrame, most: int = 1000) -> DataFrame:
    """Counts by category with subtotals, after keeping each id once and ``most`` a project."""
    once = numbered(diagnostics.select("project_id", "id", "category").distinct(), ["project_id"], ["id", "category"], "__nth").where(F.col("__nth") <= most)
    return once.rollup("project_id", "category").agg(F.count("*").alias("n"))


def discovered_flags(edges: DataFrame) -> DataFrame:
    """Sorted distinct names that conditions refer to."""
    from loomgraph.functions.text import condition_refs

    return edges.select("project_id", F.explode(condition_refs(F.col("expression"))).alias("flag")).distinct().orderBy("project_id", "flag")


def combined_locations(nodes: DataFrame) -> DataFrame:
    """The span of each collapsed chain in a file: least start, greatest end (line, char)."""
    return nodes.groupBy("project_id", "head", "file").agg(F.min(F.struct("start_line", "start_char")).alias("start"), F.max(F.struct("end_line", "end_char")).alias("end"))
