"""Knowledge graphs from JSON documents, JSON lines and Parquet.

Each loader returns ``(entities, triples)`` as in ``operators.kg``.  Pickled graphs are not read: loading one
runs code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.text import first_text
from strandwise.operators.kg import META, META_FIELDS, entity_name, meta_struct, parse_triples
from strandwise.operators.rank import dense_ids
from strandwise.sources.json_sources import read_lines, write_lines
from strandwise.workspace import Workspace

ALIASES = {"head": ("head", "h", "subject"), "relation": ("relation", "r", "predicate"), "tail": ("tail", "t", "object")}
LINE = ", ".join(f"{x} STRING" for names in ALIASES.values() for x in names) + ", " + META
BUNDLE_ENTITY = "id BIGINT, name STRING, surface STRING, type STRING"


@dataclass
class Graph:
    entities: DataFrame
    triples: DataFrame

    def saved(self, spark: SparkSession) -> Graph:
        """The graph written to the shared folder and read from there."""
        ws = Workspace(spark, "graph")
        return Graph(ws.save(self.entities, "entities"), ws.save(self.triples, "triples"))


def _placed(rows: DataFrame, into: str) -> DataFrame:
    """Rows numbered in the order of their files and lines."""
    marked = rows.withColumn("__file", F.col("_metadata.file_path")).withColumn("__line", F.monotonically_increasing_id())
    return dense_ids(marked, ["__file", "__line"], into).drop("__file", "__line")


def _alias(part: str):
    return F.coalesce(*[F.col(c) for c in ALIASES[part]])


def read_bundle(spark: SparkSession, path: str) -> Graph:
    """``entities.jsonl`` and ``triples.jsonl`` of a folder; ids of triples are lines of their file.

    An id 0 is an id like others.
    """
    found = read_lines(spark, f"{path}/entities.jsonl", BUNDLE_ENTITY).filter("id is not null")
    entities = found.select("id", F.coalesce(entity_name(F.col("name"), F.col("surface")), F.col("id").cast("string")).alias("name"), "type")
    lines = _placed(read_lines(spark, f"{path}/triples.jsonl", LINE).select("*", "_metadata"), "triple_id")
    raw = lines.select("triple_id", _alias("head").alias("h"), _alias("relation").alias("r"), _alias("tail").alias("t"), meta_struct({n: F.col(n) for n in META_FIELDS}).alias("meta"))
    return Graph(entities, parse_triples(raw, entities))


def read_named(spark: SparkSession, path: str, falsy_is_missing: bool = False) -> Graph:
    """JSON lines of triples between names, in files that are read in the order of their names.

    Every distinct name is an entity, numbered in the order of appearance, head before tail.  Lines without
    all three parts go; with ``falsy_is_missing`` so do parts that are 0 or empty.
    """
    rows = read_lines(spark, path, LINE).select("*", "_metadata")
    part = lambda p: first_text(*[F.nullif(F.col(c), F.lit("0")) for c in ALIASES[p]]) if falsy_is_missing else _alias(p)
    parts = rows.select("*", part("head").alias("__h"), part("relation").alias("__r"), part("tail").alias("__t")).filter("__h is not null and __r is not null and __t is not null")
    lines = _placed(parts, "triple_id").select("triple_id", F.col("__h").alias("h"), F.col("__r").alias("r"), F.col("__t").alias("t"), meta_struct({n: F.col(n) for n in META_FIELDS}).alias("meta"))
    ends = lines.select(F.posexplode(F.array("h", "t")).alias("side", "name"), "triple_id")
    firsts = ends.groupBy("name").agg(F.min(F.struct("triple_id", "side")).alias("at")).select("name", "at.triple_id", "at.side")
    entities = dense_ids(firsts, ["triple_id", "side"], "id").select("id", "name", F.lit(None).cast("string").alias("type"))
    named = entities.select("id", "name")
    triples = (
        lines.join(named.select(F.col("id").alias("head_id"), F.col("name").alias("h")), "h")
        .join(named.select(F.col("id").alias("tail_id"), F.col("name").alias("t")), "t")
        .select("triple_id", "head_id", "tail_id", F.col("r").alias("relation"), F.col("h").alias("head"), F.col("t").alias("tail"), "meta")
    )
    return Graph(entities, triples)


def read_document_graph(spark: SparkSession, path: str) -> Graph:
    """One JSON object with ``entities`` (objects, or names) and ``triples`` (objects, or lists of three)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<entities: array<string>, triples: array<string>>").alias("g"))
    ents = raw.select(F.posexplode("g.entities").alias("id", "e"))
    obj = F.from_json("e", "struct<name: string, surface: string, type: string>")
    entities = ents.select(F.col("id").cast("long").alias("id"), F.coalesce(entity_name(obj["name"], obj["surface"]), F.col("e")).alias("name"), obj["type"].alias("type"))
    tris = raw.select(F.posexplode("g.triples").alias("triple_id", "x"))
    own, three = F.from_json("x", f"struct<{_fields(LINE)}>"), F.from_json("x", "array<string>")
    listed = F.startswith(F.ltrim("x"), F.lit("["))
    pick = lambda p, k: F.when(listed, F.get(three, k)).otherwise(F.coalesce(*[own[c] for c in ALIASES[p]]))
    rows = tris.select(F.col("triple_id").cast("long").alias("triple_id"), pick("head", 0).alias("h"), pick("relation", 1).alias("r"), pick("tail", 2).alias("t"), meta_struct({n: own[n] for n in META_FIELDS}).alias("meta"))
    return Graph(entities, parse_triples(rows, entities))


def _fields(ddl: str) -> str:
    return ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in ddl.split(", "))


def read_tables(spark: SparkSession, path: str) -> Graph:
    """Parquet tables ``entities`` and ``triples`` of a folder, as ``write_tables`` leaves them."""
    return Graph(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/triples"))


def write_tables(graph: Graph, path: str) -> None:
    graph.entities.write.mode("overwrite").parquet(f"{path}/entities")
    graph.triples.write.mode("overwrite").parquet(f"{path}/triples")


def write_bundle(entities: DataFrame, triples: DataFrame, title_entities: DataFrame, title_triples: DataFrame, path: str) -> None:
    """The four line files of a built graph; rows of each are in the order of their ids."""
    write_lines(entities.select("id", "name", "type").orderBy("id"), f"{path}/entities.jsonl")
    write_lines(triples.orderBy("triple_id").select("h", "t", "r", "evidence", "title"), f"{path}/triples.jsonl")
    write_lines(title_entities, f"{path}/title2entities.jsonl")
    write_lines(title_triples, f"{path}/title2triples.jsonl")


def load_graph(spark: SparkSession, path: str) -> Graph:
    """By what the path is: a JSON document, or a folder of Parquet tables, of a bundle, or of named lines."""
    if path.endswith(".pt"):
        raise ValueError("pickled graphs are not read; export entities and triples as JSON or Parquet")
    if path.endswith((".json", ".jsonl")):
        return read_document_graph(spark, path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    if has("entities.jsonl") and has("triples.jsonl"):
        return read_bundle(spark, path)
    if has("entities") and has("triples"):
        return read_tables(spark, path)
    if fs.exists(at):
        return read_named(spark, path)
    raise FileNotFoundError(path)
