"""Weighted edge lists as GEXF, GraphML and CSV, and enriched vertical files.

XML is written by Spark as lines in order: opening, nodes, edges, closing; the part files, put
together in order of their names, are the file. Defined cases: special characters are escaped; an
existing folder is never overwritten; edges without an attribute have no colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswerk.operators.graph import large_components, vertices


def escaped(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def kept_components(edges: DataFrame, more_than: int | None) -> DataFrame:
    """Edges of components with more than so many nodes."""
    if not more_than:
        return edges
    kept = large_components(vertices(edges), edges, more_than).select(F.col("node").alias("src"))
    return edges.join(kept, "src", "left_semi")


def gexf_lines(edges: DataFrame, colours: dict[str, tuple[int, int, int]] | None = None, attribute: str | None = None, more_than: int | None = None) -> DataFrame:
    """(section, key, line) of (src, dst, weight and perhaps an attribute that has a colour)."""
    edges = kept_components(edges, more_than)
    nodes = vertices(edges).select(F.lit(1).alias("section"), F.col("node").alias("key"), F.format_string('<node id="%s" label="%s"/>', escaped("node"), escaped("node")).alias("line"))
    colour = F.lit("")
    for value, (r, g, b) in (colours or {}).items():
        colour = F.when(F.col(attribute) == value, f'<viz:color r="{r}" g="{g}" b="{b}" a="1"/>').otherwise(colour)
    line = F.concat(F.format_string('<edge source="%s" target="%s" weight="%s">', escaped("src"), escaped("dst"), F.col("weight").cast("string")), colour, F.lit("</edge>"))
    ties = edges.select(F.lit(3).alias("section"), F.concat_ws("\u0001", "src", "dst").alias("key"), line.alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2"><graph defaultedgetype="undirected"><nodes>'
    frame = edges.sparkSession.createDataFrame([(0, "", head), (2, "", "</nodes><edges>"), (4, "", "</edges></graph></gexf>")], "section int, key string, line string")
    return nodes.unionByName(ties).unionByName(frame)


def graphml_lines(edges: DataFrame) -> DataFrame:
    """(section, key, line)."""
    nodes = vertices(edges).select(F.lit(1).alias("section"), F.col("node").alias("key"), F.format_string('<node id="%s"/>', escaped("node")).alias("line"))
    line = F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', escaped("src"), escaped("dst"), F.col("weight").cast("string"))
    ties = edges.select(F.lit(2).alias("section"), F.concat_ws("\u0001", "src", "dst").alias("key"), line.alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    frame = edges.sparkSession.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "section int, key string, line string")
    return nodes.unionByName(ties).unionByName(frame)


def write_lines(lines: DataFrame, path: str) -> None:
    """Part files in order."""
    lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("line").write.mode("errorifexists").text(path)


def edge_csv(edges: DataFrame) -> DataFrame:
    """(line): src;dst;weight."""
    return edges.select(F.concat_ws(";", "src", "dst", F.col("weight").cast("string")).alias("line"))


def enriched_lines(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """(sid, ix, line): token rows with TABs between, null as nothing."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return tokens.select("sid", "ix", F.concat_ws("\t", *cells).alias("line"))


def target_path(path: str | Column, old: str, new: str) -> Column:
    """The path of an enriched file; raises where it would be the path of its source."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.replace(path, F.lit(old), F.lit(new))
    return F.when(out == path, F.raise_error(F.concat(F.lit("would overwrite "), path)).cast("string")).otherwise(out)
