"""Import edges, layers, and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.session import ensure_checkpoints

# Words in a directory's name that tell its layer, outermost last.
LAYER_WORDS = {"domain": ["domain", "entities", "entity", "models", "core"], "application": ["application", "usecases", "use_cases", "services"], "infrastructure": ["infrastructure", "infra", "adapters", "repositories", "persistence", "db"], "interface": ["interface", "interfaces", "api", "controllers", "routes", "views", "handlers", "web"]}
LAYER_RANK = {"domain": 0, "application": 1, "infrastructure": 2, "interface": 3}


def layers_of(files: DataFrame, path: str = "path", words: dict[str, list[str]] | None = None) -> DataFrame:
    """path, layer: the layer of the innermost directory whose name is, begins or ends with one of a layer's words."""
    words = words or LAYER_WORDS
    spark = files.sparkSession
    dim = spark.createDataFrame([(layer, w, i) for i, (layer, ws) in enumerate(words.items()) for w in ws], "layer string, word string, ord int")
    parts = F.split(F.lower(path), "/")
    dirs = files.select(F.col(path).alias("path"), F.posexplode(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))).alias("depth", "dir"))
    hit = dirs.join(F.broadcast(dim), F.expr("dir = word or endswith(dir, concat('_', word)) or startswith(dir, concat(word, '_'))"))
    return hit.groupBy("path").agg(F.min_by("layer", F.struct(-F.col("depth"), "ord")).alias("layer"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: imports (path, module, level) resolved to files of the corpus; a level counts parents of the importing file.

    Candidates are the module as a file and as a package; the first that exists counts."""
    parts = F.split("path", "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.greatest(F.col("level"), F.lit(1)))), "/")
    module = F.translate(F.coalesce("module", F.lit("")), ".", "/")
    target = F.when(F.col("level") > 0, F.concat_ws("/", F.when(base != "", base), F.when(module != "", module))).otherwise(module)
    tries = imports.select(F.col("path").alias("src"), F.posexplode(F.array(F.concat(target, F.lit(".py")), F.concat(target, F.lit("/__init__.py")))).alias("rank", "dst"))
    found = tries.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return found.select("src", "dst").distinct()


def violations(edges: DataFrame, layer: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """src, dst, src_layer, dst_layer of edges from an inner to an outer layer. layer: path, layer."""
    ranks = ranks or LAYER_RANK
    spark = edges.sparkSession
    dim = layer.join(F.broadcast(spark.createDataFrame(list(ranks.items()), "layer string, rank int")), "layer")
    a = dim.select(F.col("path").alias("src"), F.col("layer").alias("src_layer"), F.col("rank").alias("ra"))
    b = dim.select(F.col("path").alias("dst"), F.col("layer").alias("dst_layer"), F.col("rank").alias("rb"))
    return edges.join(a, "src").join(b, "dst").where("ra < rb").select("src", "dst", "src_layer", "dst_layer")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, hops: all nodes that can be reached from the starts (node), with the fewest steps; lineage is cut each step."""
    ensure_checkpoints(edges.sparkSession)
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct().checkpoint()
    front, hops = seen, 0
    while not front.isEmpty():
        hops += 1
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        seen = seen.unionByName(front).checkpoint()
    return seen
