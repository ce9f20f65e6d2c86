"""Features of a node from what it is connected with: by region, by projection, by partner type and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likegraph.functions.process import Process, scaled_process
from likegraph.operators.frames import Blocks, FeatureFrame
from likegraph.sources.graph import Graph, bodies, count, parse_roi
from likegraph.spread import joined

SIDES = ("(L)", "(R)")
#: Connections and regions of fewer synapses don't count in projections.
CUTOFF = 3


def rank_slots(rows: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """rows with slot: the rank of value within (bodyid, group), from the largest; ties by partner if there is one."""
    last = ["partner"] if "partner" in rows.columns else []
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("bodyid", *group).orderBy(F.col(value).desc(), *last)))


def _plain(region: Column, excluded: tuple[str, ...] | list[str]) -> Column:
    for part in excluded:
        region = F.replace(region, F.lit(part), F.lit(""))
    return region


def roi_overlap_blocks(graph: Graph, targets, sym_excl=SIDES, roilist: list[str] | None = None, post_factor: int = 5) -> Blocks:
    """A node's own synapses by region: pre in the in block (label region<=), post times post_factor in the out block (region=>).

    Regions that differ by a part in sym_excl are one. Only counts above 0 make rows; nodes without any,
    or missing, are rows of zeros.
    """
    who = bodies(graph.nodes.sparkSession, targets)
    rows = graph.nodes.join(who.select(F.col("bodyid").alias("bodyId")), "bodyId", "left_semi").select(F.col("bodyId").alias("bodyid"), F.explode(parse_roi("roiInfo")).alias("region", "v"))
    rows = rows.join(F.broadcast(graph.super_rois(roilist)), "region", "left_semi").withColumn("name", _plain(F.col("region"), sym_excl))
    both = rows.select("bodyid", "name", F.explode(F.array(F.struct(F.lit("in").alias("direction"), count("pre").alias("n")), F.struct(F.lit("out").alias("direction"), (count("post") * post_factor).alias("n")))).alias("s")).select("bodyid", "name", "s.*")
    label = F.concat("name", F.when(F.col("direction") == "in", "<=").otherwise("=>"))
    return Blocks(who, both.filter("n > 0").groupBy("bodyid", "direction", label.alias("feature")).agg(F.sum("n").cast("double").alias("value")))


def projection_blocks(graph: Graph, targets, sym_excl=SIDES, roilist: list[str] | None = None) -> Blocks:
    """Where a node's connections lie (first region) and where its partners' other synapses lie (second region).

    A connection's synapses in the first region are shared out over its partner's second regions, by the
    partner's pre and by its post counts. Second regions are those seen among input partners. Columns that
    differ by side are one group, ranked by value in each row: label first<second>#slot.
    """
    spark = graph.nodes.sparkSession
    who = bodies(spark, targets)
    regions = F.broadcast(graph.super_rois(roilist, none_region=roilist is None))
    traced = graph.nodes.filter("status = 'Traced'").select(F.col("bodyId").alias("partner"), F.col("roiInfo").alias("info"))
    sides = {d: graph.touching(who, d).filter(F.col("weight") >= CUTOFF).join(traced, "partner") for d in ("in", "out")}
    own = lambda d: sides[d].select("bodyid", "partner", F.explode(parse_roi("roiInfo")).alias("region", "v")).select("bodyid", "partner", "region", count("post").alias("n")).filter(F.col("n") >= CUTOFF).join(regions, "region", "left_semi")
    second = sides["in"].select("partner", "info").dropDuplicates(["partner"]).select(F.explode(F.map_keys(parse_roi("info"))).alias("region")).distinct().join(regions, "region", "left_semi")
    rows = None
    for d, dil in (("in", "<="), ("out", "=>")):
        places = sides[d].select("partner", "info").dropDuplicates(["partner"]).select("partner", F.explode(parse_roi("info")).alias("region", "v")).join(F.broadcast(second), "region", "left_semi")
        places = places.select("partner", F.col("region").alias("other"), F.explode(F.array(F.struct(F.lit("<=").alias("side"), count("pre").alias("m")), F.struct(F.lit("=>").alias("side"), count("post").alias("m")))).alias("s")).select("partner", "other", "s.*")
        total = places.groupBy("partner", "side").agg(F.sum("m").alias("all"))
        share = places.filter("m > 0").join(total, ["partner", "side"]).select("partner", "other", "side", (F.col("m") / F.col("all")).alias("share"))
        cells = own(d).join(share, "partner").groupBy("bodyid", "region", "other", "side").agg(F.sum(F.col("n") * F.col("share")).alias("value"))
        cells = cells.withColumns({"a": _plain(F.col("region"), sym_excl), "b": _plain(F.col("other"), sym_excl)})
        slot = F.row_number().over(Window.partitionBy("bodyid", "a", "b", "side").orderBy(F.col("value").desc(), "region", "other"))
        part = cells.withColumn("slot", slot).select("bodyid", F.lit(d).alias("direction"), F.concat("a", F.lit(dil), F.lit("("), "b", "side", F.lit(")#"), F.col("slot").cast("string")).alias("feature"), "value")
        rows = part if rows is None else rows.unionByName(part)
    return Blocks(who, rows)


def clean_type(column: str = "type") -> Column:
    """A saved type without the marks put_ and _pct; empty is none."""
    return F.nullif(F.replace(F.replace(F.col(column), F.lit("put_")), F.lit("_pct")), F.lit(""))


def connections(graph: Graph, targets, minconn: int = 3, roi_restriction: list[str] | None = None, statuses: tuple[str, ...] = ("Anchor",)) -> tuple[DataFrame, DataFrame]:
    """(bodies, rows): what the similarity of connections is made of, before types: bodyid, direction, partner, saved, value.

    Partners of the given statuses, weight at least minconn, no loops; with a restriction the value is the
    sum of post over its regions, again at least minconn. Kept, it is all that later rounds need.
    """
    who = bodies(graph.nodes.sparkSession, targets)
    allowed = graph.nodes.filter(F.col("status").isin(*statuses)).select(F.col("bodyId").alias("partner"), clean_type().alias("saved"))
    rows = None
    for d in ("in", "out"):
        part = graph.touching(who, d).filter(F.col("weight") >= minconn).withColumn("direction", F.lit(d))
        rows = part if rows is None else rows.unionByName(part)
    value = F.col("weight")
    if roi_restriction is not None:
        wanted = F.array(*map(F.lit, roi_restriction))
        value = F.aggregate(F.map_values(F.map_filter(parse_roi("roiInfo"), lambda k, _: F.array_contains(wanted, k))), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v["post"], F.lit(0)))
    rows = rows.withColumn("value", F.coalesce(value, F.lit(0)).cast("double")).filter(F.col("value") >= minconn)
    return who, rows.join(allowed, "partner").select("bodyid", "direction", "partner", "saved", "value")


def last_types(types: DataFrame | dict | None, spark) -> DataFrame | None:
    """(partner, custom) from (bodyid, type) with at most one row a body; of a dict's equal keys the last has won already. Frames: a body's greatest type."""
    if types is None or isinstance(types, dict) and not types:
        return None
    if isinstance(types, dict):
        types = spark.createDataFrame([(int(k), str(v)) for k, v in types.items()], "bodyid long, type string")
    return types.groupBy(F.col("bodyid").alias("partner")).agg(F.max(F.col("type").cast("string")).alias("custom"))


def connection_blocks(who: DataFrame, rows: DataFrame, use_saved_types: bool = True, customtypes: DataFrame | dict | None = None, sort_types: bool = True, pattern_only: bool = False, morph_only: bool = False) -> Blocks:
    """Features from ``connections``: by partner type (custom, else saved, else none).

    sort_types: an untyped partner is a feature of its own; typed ones are ranked by value in each row and
    direction, label c-type#slot. Else values of a type are summed. pattern_only: all partners are one type.
    Labels of inputs end in =>, those of outputs in <=.
    """
    if pattern_only:
        sort_types, use_saved_types, customtypes = True, False, None
    custom = last_types(customtypes, rows.sparkSession)
    rows = rows.join(custom, "partner", "left") if custom is not None else rows.withColumn("custom", F.lit(None).cast("string"))
    kind = F.coalesce("custom", "saved") if use_saved_types else F.col("custom")
    if pattern_only:
        kind = F.lit("ph")
    if morph_only:
        kind = F.regexp_replace(kind, "^(.*)_[a-z]$", "$1")
    rows = rows.withColumn("kind", kind)
    dil = F.when(F.col("direction") == "in", "=>").otherwise("<=")
    if not sort_types:
        label = F.concat(F.lit("c-"), F.coalesce("kind", F.col("partner").cast("string")), dil)
        return Blocks(who, rows.groupBy("bodyid", "direction", label.alias("feature")).agg(F.sum("value").alias("value")))
    typed = rank_slots(rows.filter("kind is not null"), ["direction", "kind"]).select("bodyid", "direction", F.concat(F.lit("c-"), "kind", F.lit("#"), F.col("slot").cast("string"), dil).alias("feature"), "value")
    single = rows.filter("kind is null").select("bodyid", "direction", F.concat(F.lit("c-"), F.col("partner").cast("string"), dil).alias("feature"), "value")
    return Blocks(who, typed.unionByName(single))


def partner_types(partners: DataFrame, use_saved_types: bool = True, customtypes: DataFrame | dict | None = None) -> DataFrame:
    """(partner, kind, mark) of partners (partner, saved): custom, else saved type, and what that type is made of, whatever its name."""
    custom = last_types(customtypes, partners.sparkSession)
    rows = partners.join(custom, "partner", "left") if custom is not None else partners.withColumn("custom", F.lit(None).cast("string"))
    rows = rows.select("partner", (F.coalesce("custom", "saved") if use_saved_types else F.col("custom")).alias("kind"))
    one, two = F.xxhash64("partner"), F.xxhash64(F.lit(1), "partner")
    marks = rows.filter("kind is not null").groupBy("kind").agg(F.concat_ws(":", F.count("*"), F.min("partner"), F.bit_xor(one), F.bit_xor(two)).alias("mark"))
    return joined(rows.filter("kind is not null"), marks, ["kind"]).select("partner", "kind", "mark").unionByName(rows.filter("kind is null").withColumn("mark", F.lit(None).cast("string")))


def unranked(rows: DataFrame) -> DataFrame:
    """``connections`` before their first ranks."""
    return rows.select("bodyid", "direction", "partner", "value", F.lit(None).cast("string").alias("mark"), F.lit(None).cast("int").alias("slot"))


def rank_again(rows: DataFrame, kinds: DataFrame, sizes: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """rows (bodyid, direction, partner, value, mark, slot) under the types kinds: with kind, and whether the slot is fresh.

    A type that is made of the same partners as the one before, under whatever name, leaves its rows in
    their slots; only the others are sorted anew. sizes (partner, _n): rows of each partner, if they are known.
    """
    named = joined(rows, kinds.withColumnRenamed("mark", "now"), ["partner"], sizes, total)
    same = F.col("mark").eqNullSafe(F.col("now"))
    out = ("bodyid", "direction", "partner", "value", "kind", F.col("now").alias("mark"), "slot")
    fresh = rank_slots(named.filter(~same & F.col("now").isNotNull()).drop("slot"), ["direction", "kind"])
    single = named.filter(~same & F.col("now").isNull()).withColumn("slot", F.lit(None).cast("int"))
    return named.filter(same).select(*out, F.lit(False).alias("fresh")).unionByName(fresh.unionByName(single).select(*out, F.lit(True).alias("fresh")))


def ranked_blocks(who: DataFrame, ranked: DataFrame) -> Blocks:
    """Features of ``rank_again``, as ``connection_blocks`` makes them of sorted types."""
    dil = F.when(F.col("direction") == "in", "=>").otherwise("<=")
    label = F.when(F.col("kind").isNull(), F.concat(F.lit("c-"), F.col("partner").cast("string"), dil)).otherwise(F.concat(F.lit("c-"), "kind", F.lit("#"), F.col("slot").cast("string"), dil))
    return Blocks(who, ranked.select("bodyid", "direction", label.alias("feature"), "value"))


def extract_roioverlap_features(graph: Graph, targets, postprocess: Process | None = None, **options) -> FeatureFrame:
    return roi_overlap_blocks(graph, targets, **options).made(postprocess or scaled_process(0.5, 0.5, [0.66, 0, 0.33]))


def extract_projection_features(graph: Graph, targets, postprocess: Process | None = None, **options) -> FeatureFrame:
    return projection_blocks(graph, targets, **options).made(postprocess or scaled_process(0.5, 0.5, [0.66, 0, 0.33]))


def compute_connection_similarity_features(graph: Graph | None, targets=None, use_saved_types=True, customtypes=None, postprocess: Process | None = None, sort_types=True, pattern_only=False, minconn=3, roi_restriction=None, dump_replay=False, replay_data=None, morph_only=False, statuses=("Anchor",)):
    """A FeatureFrame; with dump_replay, what replay_data takes in later calls instead of the graph."""
    replay = replay_data or connections(graph, targets, minconn, roi_restriction, tuple(statuses))
    if dump_replay:
        return replay
    return connection_blocks(*replay, use_saved_types, customtypes, sort_types, pattern_only, morph_only).made(postprocess or scaled_process(0.5, 0.5, [0.9, 0.0, 0.1]))


def extract_neighbors(graph: Graph, targets, minconn: int = 3) -> DataFrame:
    """(bodyid): targets and their traced partners, either way, of weight at least minconn; a loop counts."""
    who = bodies(graph.nodes.sparkSession, targets).select("bodyid")
    strong = graph.edges.filter(F.col("weight") >= minconn)
    both = strong.select(F.col("src").alias("bodyid"), F.col("dst").alias("p")).union(strong.select(F.col("dst"), F.col("src")))
    found = both.join(who, "bodyid", "left_semi").select(F.col("p").alias("bodyid")).distinct()
    traced = graph.nodes.filter("status = 'Traced'").select(F.col("bodyId").alias("bodyid"))
    return who.union(found.join(traced, "bodyid", "left_semi")).distinct()


