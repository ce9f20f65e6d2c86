"""A graph made of the provided star schema: customers supply suppliers, suppliers products, products customers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likegraph.sources.graph import Graph
from likegraph.stored import written

# Fixed values of the adapter.
KINDS = ("SMALL", "LARGE", "STANDARD", "ECONOMY", "MEDIUM")
SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")


def _number(column, names):
    out = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        out = F.when(column == name, i).otherwise(out)
    return out


def _rare(column, names):
    """A type that its number doesn't tell."""
    return F.when(~column.isin(*names), column)


def _told(number, rare, names):
    """The type again, of a node's number and what ``_rare`` has left."""
    return F.coalesce(rare, F.element_at(F.array(*map(F.lit, names), F.lit(None).cast("string")), (F.pmod(number, F.lit(10)) + 1).cast("int")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line item: supplier s, product p, customers c, whether on the left, and types of p and c that their numbers don't tell.

    Line items move by order and by part, as a few numbers; the region follows from c.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    segment, kind = F.col("c_mktsegment"), F.col("p_type")
    places = read("nation").join(read("region").select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    buyers = read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", (2_000_000 + F.col("c_nationkey") * 10 + _number(segment, SEGMENTS)).cast("int").alias("c"), _rare(segment, SEGMENTS).alias("ctype"))
    orders = read("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c", "ctype")
    goods = read("part").select("p_partkey", (1_000_000 + F.substring("p_brand", 7, 9).cast("long") * 10 + _number(kind, KINDS)).alias("p"), _rare(kind, KINDS).alias("ptype"))
    line = read("lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").cast("long").alias("s"), F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).alias("left"))
    line = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "s", "left", "c", "ctype")
    return line.join(goods, F.col("l_partkey") == F.col("p_partkey")).select("s", "left", F.col("c").cast("long").alias("c"), "ctype", "p", "ptype")


def _graph_and_lines(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The graph, from one pass over the line items, and these.

    They move once more, to their supplier, and are cached there: edges of suppliers are counted from them
    without another move. Edges of products and customers are few and are counted before they move.
    """
    nation, region = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("nation", "region"))
    names = F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("place"), "r_name"))
    source = lines(spark, sf_dir).repartition("s").persist()
    line = source.withColumn("place", F.floor((F.col("c") - 2_000_000) / 10)).join(names, "place")

    def by_region(rows, *by):
        """Line items by (by, region): n. Types are no aggregates: a largest string would have to be sorted for."""
        named = rows.select(*by, F.concat("r_name", F.when(F.col("left"), "(L)").otherwise("(R)")).alias("region"))
        return named.groupBy(*by, "region").agg(F.count("*").alias("n"))

    roi = lambda value: F.to_json(F.map_from_entries(F.collect_list(F.struct("region", value))))
    edge = lambda rows, *by: rows.withColumnRenamed("n", "post").groupBy(*by).agg(F.sum("post").alias("weight"), roi(F.struct("post")).alias("roiInfo"))
    ends = lambda rows, src, dst, *more: rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more)
    # a supplier of a number that a product or customers may have can have edges that are theirs
    apart = F.coalesce(F.col("s") < 1_000_000, F.lit(False))
    own, others = line.filter(apart), line.filter(~apart)
    edges = None
    for src, dst in (("c", "s"), ("s", "p")):
        part = ends(edge(by_region(own, src, dst), src, dst), src, dst, "weight", "roiInfo")
        edges = part if edges is None else edges.unionByName(part)
    few = ends(by_region(line, "p", "c"), "p", "c", "region", "n")
    for src, dst in (("c", "s"), ("s", "p")):
        few = few.unionByName(ends(by_region(others, src, dst), src, dst, "region", "n"))
    few = few.groupBy("src", "dst", "region").agg(F.sum("n").alias("n"))
    edges = edges.unionByName(edge(few, "src", "dst"))

    # each line item goes into its supplier, its product and its customers once, and out once
    node = lambda rows, body, type: rows.select(F.col(body).alias("bodyId"), "region", type.alias("type"), "n")
    both = node(by_region(line, "s"), "s", F.lit("sup"))
    both = both.unionByName(node(by_region(line, "p", "ptype"), "p", _told(F.col("p"), F.col("ptype"), KINDS)))
    both = both.unionByName(node(by_region(line, "c", "ctype"), "c", _told(F.col("c"), F.col("ctype"), SEGMENTS)))
    both = both.groupBy("bodyId", "region").agg(F.max("type").alias("type"), F.sum("n").alias("pre"), F.sum("n").alias("post"))
    nodes = both.groupBy("bodyId").agg(F.max("type").alias("t"), roi(F.struct("pre", "post")).alias("roiInfo"))
    nodes = nodes.select(
        "bodyId",
        F.when(F.col("bodyId") % 11 != 0, F.col("t")).alias("type"),
        F.concat(F.lit("n"), F.col("bodyId").cast("string")).alias("instance"),
        F.when(F.col("bodyId") % 3 != 0, "Anchor").otherwise("Traced").alias("status"),
        (F.col("bodyId") % 7 == 0).alias("cropped"),
        "roiInfo",
    )
    names = region.select(F.explode(F.array(F.concat("r_name", F.lit("(L)")), F.concat("r_name", F.lit("(R)")))).alias("r"))
    return Graph(nodes, edges, names.agg(F.sort_array(F.collect_set("r")).alias("superLevelRois"))), source


def graph_of_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; each reading of its nodes or edges counts them anew, from line items that are cached until the cache is cleared."""
    return _graph_and_lines(spark, sf_dir)[0]


class WrittenGraph(Graph):
    """``graph_of_tables`` for operators that read it several times: nodes and edges are written when they are first asked for, and the line items cached until both are.

    Cached nodes and edges would bring their plans into each plan that reads them, once for each reading.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        graph, lines = _graph_and_lines(spark, sf_dir)
        self.__dict__.update(meta=graph.meta, _made={"nodes": graph.nodes, "edges": graph.edges}, _lines=lines)

    def _written(self, name: str) -> DataFrame:
        out = written(self._made.pop(name), name)
        if not self._made:
            self._lines.unpersist()
        return out

    @cached_property
    def nodes(self) -> DataFrame:
        return self._written("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self._written("edges")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets: (bodyid)."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("bodyid"))
