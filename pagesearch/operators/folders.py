"""Folder paths of a bookmark tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.session import materialize


def folder_paths(nodes: DataFrame) -> DataFrame:
    """node_id, url, path, depth of all nodes that a root (null ``parent_id``)
    leads to; ``path`` joins the names from the root on with ``/``.

    One join a level: the nodes whose parent was reached last.  Each level is
    written once to the shared folder, so there is no limit on rows or depth
    and lineage stays one level long.  Ids that occur twice and form a circle
    are an error; a circle that no root leads to has no rows."""
    limit = nodes.count()
    level = materialize(nodes.where("parent_id IS NULL")
                        .select("node_id", "url", F.col("name").alias("path"), F.lit(0).cast("bigint").alias("depth")), "level")
    out = level
    for depth in range(1, limit + 2):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_up"))
        level = materialize(nodes.join(up, "parent_id")
                            .select("node_id", "url", F.concat_ws("/", "_up", "name").alias("path"), F.lit(depth).cast("bigint").alias("depth")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("the nodes form a circle")
