"""Entry points from annotation facts: routes, listeners and schedules, with what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fill_template, join_path, join_template

#: Annotations that map routes, and the method each stands for (fixed values of the public framework).
MAPPINGS = {"GetMapping": "GET", "PutMapping": "PUT", "PostMapping": "POST", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
CONTROLLERS = ("Controller", "RestController")
#: Attributes of the other framework that map routes (fixed values).
VERBS = {"HttpGet": "GET", "HttpPut": "PUT", "HttpPost": "POST", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}


def composed(annotations: DataFrame, meta: DataFrame, rounds: int = 8) -> DataFrame:
    """Annotations with those they are composed of; meta: name, base.  Values of the outer one stay; rounds end cycles."""
    out, front = annotations, annotations
    for _ in range(rounds):
        front = front.join(meta, "name").select(*[F.col("base").alias("name") if c == "name" else F.col(c) for c in annotations.columns])
        out = out.unionByName(front)
    return out.distinct()


def jvm_routes(annotations: DataFrame) -> DataFrame:
    """(class, member, http_method, path, gap) of annotations (class, member, name, path, http_method); members of controllers only.

    ``member`` is null for those of the class; null paths are empty.
    """
    own = annotations.where("member is null")
    controller = own.where(F.col("name").isin(*CONTROLLERS)).select("class").distinct()
    base = own.where("name = 'RequestMapping'").groupBy("class").agg(F.count("*").alias("n"), F.min(F.coalesce("path", F.lit(""))).alias("base"))
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in MAPPINGS.items() for x in kv]), F.col("name"))
    member = annotations.where("member is not null").where(F.col("name").isin("RequestMapping", *MAPPINGS))
    rows = member.join(controller, "class").join(base, "class", "left")
    path = join_path(F.coalesce("base", F.lit("")), F.coalesce("path", F.lit("")))
    method = F.coalesce(F.upper("http_method"), verb)
    gap = F.when(F.col("n") > 1, "CLASS_MAPPING_AMBIGUOUS").when(path.isNull(), "PATH_NOT_STATIC").when(method.isNull(), "HTTP_METHOD_UNSPECIFIED")
    return rows.select("class", "member", method.alias("http_method"), path.alias("path"), gap.alias("gap"))


def clr_routes(attributes: DataFrame) -> DataFrame:
    """As ``jvm_routes`` for attribute templates: tokens are filled in, an action from the root stands alone."""
    own = attributes.where("member is null")
    controller = own.where("name = 'ApiController'").select("class").distinct()
    base = own.where("name = 'Route'").groupBy("class").agg(F.min("path").alias("base"))
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv]), F.col("name"))
    rows = attributes.where("member is not null").where(F.col("name").isin(*VERBS)).join(controller, "class").join(base, "class", "left")
    short = F.regexp_replace("class", "Controller$", "")
    path = fill_template(join_template("base", "path"), short, "member", F.lit(None).cast("string"))
    return rows.select("class", "member", verb.alias("http_method"), path.alias("path"), F.when(path.isNull(), "TEMPLATE_NOT_STATIC").alias("gap"))


def listeners(annotations: DataFrame) -> DataFrame:
    """(class, member, kind, subject, gap) of listeners and schedules (path holds the topic or the rule)."""
    kind = F.when(F.col("name") == "KafkaListener", "KAFKA_LISTENER").when(F.col("name") == "Scheduled", "SCHEDULE")
    rows = annotations.where("member is not null").withColumn("kind", kind).where("kind is not null")
    open_ = F.col("path").isNull() | F.contains("path", F.lit("${")) | F.contains("path", F.lit("#{"))
    return rows.select("class", "member", "kind", F.when(~open_, F.col("path")).alias("subject"), F.when(open_, "VALUE_NOT_STATIC").alias("gap"))
