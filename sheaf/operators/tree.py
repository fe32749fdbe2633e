"""The directory tree of a table of paths, as ordered rows and as text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.constants import TREE_BRANCH, TREE_INDENT, TREE_ROOT_LINE


def dir_tree(df: DataFrame, root: str = ".", path: str = "path", by: str | None = None) -> DataFrame:
    """One row (root, parts, depth, line) per directory and file, in walk order.

    ``by`` names a column with each file's root, for many trees in one run; without it
    all files are below ``root``.

    Ancestors are exploded and made distinct; the distinct combines before the
    shuffle, so a directory above a third of all files is one row per task. The
    order is a range sort on the path components, which is the order of a walk
    that visits each directory's entries by name.
    """
    depth = F.size(F.split(F.col(path), "/"))
    nodes = (
        df.where(F.col(path) != "")
        .select(F.lit(root).alias("root") if by is None else F.col(by).alias("root"), path)
        .select("root", path, F.explode(F.sequence(F.lit(1), depth)).alias("_n"))
        .select("root", F.call_function("substring_index", F.col(path), F.lit("/"), F.col("_n")).alias("_node"))
        .distinct()
    )
    lines = nodes.select(
        "root",
        F.split("_node", "/").alias("parts"),
        (F.size(F.split("_node", "/")) - 1).alias("depth"),
    ).select(
        "root",
        "parts",
        "depth",
        F.concat(
            F.repeat(F.lit(TREE_INDENT), F.col("depth")),
            F.lit(TREE_BRANCH),
            F.element_at("parts", -1),
        ).alias("line"),
    )
    roots = df.sparkSession.range(0, 1, 1, 1).select(F.lit(root).alias("root"))
    if by is not None:
        roots = df.select(F.col(by).alias("root")).distinct()
    top = roots.select(
        "root",
        F.array().cast("array<string>").alias("parts"),
        F.lit(-1).alias("depth"),
        F.lit(TREE_ROOT_LINE).alias("line"),
    )
    return (
        top.unionByName(lines)
        .select("root", "parts", "depth", "line")
        .orderBy("root", "parts")
    )


def render_tree(tree: DataFrame, lines_per_block: int = 10_000) -> DataFrame:
    """The tree as text in blocks: (root, block, tree), to be read in block order.

    One string for a whole tree would have to pass through one task, so a block
    holds at most ``lines_per_block`` lines. Joined in order the blocks are the
    tree's text. ``tree`` has to come ordered, as ``dir_tree`` returns it.
    """
    row = F.monotonically_increasing_id()
    numbered = tree.select("root", "line", row.alias("_row"))
    # The id's lower 33 bits count the rows of a partition.
    part, index = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(part, 33) + F.floor(index / F.lit(lines_per_block))
    return (
        numbered.withColumn("block", block)
        .groupBy("root", "block")
        .agg(F.array_sort(F.collect_list(F.struct("_row", "line"))).alias("_lines"))
        .select(
            "root",
            "block",
            F.concat(F.array_join(F.col("_lines.line"), "\n"), F.lit("\n")).alias("tree"),
        )
    )
