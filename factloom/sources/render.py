"""Text sinks: diagrams, indented flows and lists, each built from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import escape_html
from factloom.operators.ordering import number_within


def _lines(rows: DataFrame, keys: list[str], order: list[str], line: str, out: str) -> DataFrame:
    """Lines of a document joined in order; a document is one value, so it fits a task."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x[line]), "\n").alias(out))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line): nodes (id, label), then edges (source, target, label, authority), dashed where the authority is unknown."""
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), "id", F.lit('["'), escape_html("label"), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("authority") == "UNKNOWN", " -.->|").otherwise(" -->|")
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(">", "source", "target").alias("key"), F.concat(F.lit("  "), "source", arrow, F.lit('"'), escape_html("label"), F.lit('"| '), "target").alias("line"))
    head = nodes.sparkSession.createDataFrame([(0, "", "flowchart LR")], "part int, key string, line string")
    numbered = number_within(head.unionByName(n).unionByName(e).withColumn("diagram", F.lit(1)), ["diagram"], ["part", "key", "line"], "line_no")
    return numbered.select("line_no", "line")


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def flow_tree(steps: DataFrame, owner: str) -> DataFrame:
    """(owner, tree): steps (ordinal, kind, label) as indented lines; IF and ELSE open a level, END closes one."""
    w = Window.partitionBy(owner).orderBy("ordinal")
    move = F.when(F.col("kind") == "IF", 1).when(F.col("kind") == "END", -1).otherwise(0)
    total = F.sum(move).over(w)
    # a level below zero stays zero: the running sum less its least value so far
    rows = steps.withColumn("_sum", total)
    rows = rows.withColumn("_least", F.least(F.min("_sum").over(w), F.lit(0))).withColumn("_depth", F.col("_sum") - F.col("_least"))
    before = F.coalesce(F.lag("_depth").over(w), F.lit(0))
    rows = rows.withColumn("_before", before)
    label = _one_line(F.col("label"))
    text = (
        F.when(F.col("kind") == "IF", F.concat(F.lit("[D] if ("), label, F.lit(") then")))
        .when(F.col("kind") == "ELSE", F.lit("else"))
        .when(F.col("kind") == "RETURN", F.concat(F.lit("return "), label))
        .when(F.col("kind") == "GAP", F.concat(F.lit("... (not established: "), label, F.lit(")")))
        .when(F.col("kind") != "END", label)
    )
    level = F.when(F.col("kind") == "ELSE", F.greatest(F.col("_before") - 1, F.lit(0))).otherwise(F.col("_before"))
    rows = rows.withColumn("line", F.concat(F.repeat(F.lit("  "), level.cast("int")), text)).where("line is not null")
    return _lines(rows, [owner], ["ordinal"], "line", "tree")


def markdown(rows: DataFrame, member: str, key: str, text: str, limit: int) -> DataFrame:
    """(page): a list of at most ``limit`` rows, taken from the members in turn."""
    from factloom.operators.ranking import interleave

    picked = interleave(rows, member, [key], limit)
    line = F.concat(F.lit("- **"), member, F.lit("** "), _one_line(F.col(text)))
    return _lines(picked.withColumn("line", line), [], ["position"], "line", "page")
