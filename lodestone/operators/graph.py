"""Import and name-reference graphs: resolution, reverse edges, bounded traversal, Mermaid text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import broadcast_if_small, keep

#: Extensions that a relative import may leave out, in the order they are tried (fixed values).
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
EDGE_CAP, MOST_DEPTH = 120, 6


def normalized(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(path, "/", -1), lambda s: ~s.isin("", ".")),
            F.array().cast("array<string>"),
            lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        ),
        "/",
    )


def candidates(path: Column, module: Column) -> Column:
    """Paths that an import may mean, in the order they are tried; empty for what can only be a package."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    base = normalized(F.concat(folder, module))
    bare = F.regexp_replace(base, r"\.(js|mjs|cjs)$", "")
    with_ext = [F.concat(base, F.lit(e)) for e in SCRIPT_EXTENSIONS]
    swapped = [F.when(bare != base, F.concat(bare, F.lit(e))) for e in SCRIPT_EXTENSIONS]
    index = [F.when(base == "", F.lit("index" + e)).otherwise(F.concat(base, F.lit("/index" + e))) for e in SCRIPT_EXTENSIONS]
    dotted = F.when(module.rlike(r"^[A-Za-z0-9_.]+$"), F.array(F.concat(F.regexp_replace(module, r"\.", "/"), F.lit(".py")))).otherwise(F.array().cast("array<string>"))
    return F.when(module.startswith("."), F.filter(F.array(base, *with_ext, *swapped, *index), lambda c: c.isNotNull())).otherwise(dotted)


def resolve(imports: DataFrame, paths: DataFrame, options: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, external) of imports (path, module): edges (src, dst) to the first candidate that exists; the rest (src, module)."""
    asked = imports.select("path", "module").distinct()
    tried = asked.select("path", "module", F.posexplode(options if options is not None else candidates(F.col("path"), F.col("module"))).alias("rank", "dst"))
    known = paths.select(F.col("path").alias("dst"))
    found = tried.join(known, "dst").groupBy("path", "module").agg(F.min_by("dst", "rank").alias("dst"))
    external = asked.join(found, ["path", "module"], "left_anti").select(F.col("path").alias("src"), "module")
    return found.select(F.col("path").alias("src"), "dst").distinct(), external


def name_edges(tokens: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst): files whose tokens (path, token) name a type (name, path) of another file.

    A name that several files define means the last of them by path.
    """
    last = types.groupBy("name").agg(F.max("path").alias("dst"))
    # The names are few beside the tokens of a corpus: they meet first, and only what is left is made distinct.
    return tokens.select(F.col("path").alias("src"), F.col("token").alias("name")).join(last, "name").filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def shared_names(tokens: DataFrame, types: DataFrame) -> DataFrame:
    """(name): the names of types (name) that stand among tokens (name), each once."""
    return types.select("name").distinct().join(tokens.select("name"), "name", "left_semi")


def merged(*edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """(dst, n): how many files depend on each."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"))


def reach(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth) within ``depth`` steps of ``roots`` (node): the least depth of each, frontier by frontier."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, min(depth, MOST_DEPTH) + 1):
        near = broadcast_if_small(frontier) if d > 1 else frontier
        step = near.join(edges, near["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def walk(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Edges (src, dst, depth) whose source lies fewer than ``depth`` steps from a root; edges to nodes already seen too."""
    edges = keep(edges.select("src", "dst"), "walk-edges")  # every step reads them
    near = reach(edges, roots, depth).filter(F.col("depth") < min(depth, MOST_DEPTH))
    return edges.join(near, edges["src"] == near["node"]).select("src", "dst", "depth")


def mermaid(edges: DataFrame, cap: int = EDGE_CAP) -> str:
    """The first ``cap`` edges as a Mermaid graph; nodes are numbered as they first appear."""
    numbers: dict[str, int] = {}
    out = ["graph LR"]
    rows = edges.select("src", "dst").orderBy("src", "dst").limit(cap + 1).collect()  # a picture: bounded by its cap
    for r in rows[:cap]:
        shown = []
        for node in (r["src"], r["dst"]):
            new = node not in numbers
            n = numbers.setdefault(node, len(numbers))
            label = str(node).replace('"', "'")
            shown.append(f'n{n}["{label}"]' if new else f"n{n}")
        out.append(f"  {shown[0]} --> {shown[1]}")
    return "\n".join(out + (["  %% more edges not shown"] if len(rows) > cap else []))


def top_sources(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` files with most edges out."""
    ranked = edges.groupBy("src").agg(F.count("*").alias("n"))
    return ranked.orderBy(F.desc("n"), "src").limit(n)


def ordinals(edges: DataFrame) -> DataFrame:
    """Edges numbered within their source."""
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
