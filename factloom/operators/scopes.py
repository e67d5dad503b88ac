"""Predicates on declarations and boundaries, and joins that attach evidence to what it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import join_hot

#: Kinds of callables; the syntax kinds count only where no declaration kind is given (fixed values).
CALLABLE_KINDS = ("METHOD", "CONSTRUCTOR", "FUNCTION")
CALLABLE_SYNTAX = ("function_definition", "function_declaration", "method_declaration", "constructor_declaration", "secondary_constructor")
#: Kinds that every service sees (fixed values).
SHARED_KINDS = ("DOMAIN_ENTITY", "ENTITY_SCOPE")
UNPROVEN = "CONTROLLER_REGISTRATION_UNPROVEN"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_declaration(kind: Column, declaration_kind: Column, identity: Column) -> Column:
    """By its kind, in any letter case, or by having both a declaration kind and an identity."""
    return _yes(F.lower(kind) == "declaration") | (declaration_kind.isNotNull() & identity.isNotNull())


def is_callable(declaration_kind: Column, syntax_kind: Column) -> Column:
    return _yes(F.when(declaration_kind.isNotNull(), declaration_kind.isin(*CALLABLE_KINDS)).otherwise(syntax_kind.isin(*CALLABLE_SYNTAX)))


def is_public_boundary(kind: Column, boundaries: Column, declarations: Column) -> Column:
    """``declarations``: array of (kind, controller) of the framework; a controller that is unknown is not excluded."""
    unproven = (kind == "HTTP_ENDPOINT") & _yes(F.array_contains(boundaries, UNPROVEN))
    other = _yes(F.exists(declarations, lambda d: ~_yes(d["kind"] == "HTTP_ENDPOINT") | ~_yes(d["controller"] == F.lit(False))))
    return _yes(~unproven & (~kind.startswith("SOURCE_") | other))


def in_service_scope(service: str, own: Column, kind: Column, source: Column, target: Column) -> Column:
    """Own rows, shared kinds, and declared interactions with the service at either end."""
    ends = (kind == "DECLARED_INTERACTION") & (_yes(source == service) | _yes(target == service))
    return _yes(own == service) | _yes(kind.isin(*SHARED_KINDS)) | _yes(ends)


def owned(flows: DataFrame, declarations: DataFrame) -> DataFrame:
    """(flow, declaration): flows (flow, service, symbol, owner_id) with the declarations (declaration, service, symbol,
    identity) they belong to: the pinned one, or, where none is pinned, those of their name without an identity of their own."""
    met = flows.join(declarations, ["service", "symbol"])
    return met.where(F.when(F.col("owner_id").isNotNull(), F.col("owner_id") == F.col("declaration")).otherwise(F.col("identity").isNull())).select("flow", "declaration")


def artifact_slots(facts: DataFrame, key: str, artifacts: str) -> DataFrame:
    """(key, slot, artifact, status): artifacts (slot, artifact) of a compilation one by one; OK, or SLOT_REPEATED for all
    rows of a compilation that names a slot twice."""
    rows = facts.select(key, F.explode(artifacts).alias("a"), (F.size(F.array_distinct(F.transform(artifacts, lambda a: a["slot"]))) < F.size(artifacts)).alias("twice"))
    return rows.select(key, F.col("a.slot").alias("slot"), F.col("a.artifact").alias("artifact"), F.when(F.col("twice"), "SLOT_REPEATED").otherwise("OK").alias("status"))


def library_links(calls: DataFrame, bindings: DataFrame, declarations: DataFrame) -> DataFrame:
    """(binding, call, declaration, status).

    Calls (call, consumer, target) go on in a library (binding, consumer, library) where exactly one of its declarations
    (declaration, library, identity) is their target: CANDIDATE_CONTINUATION.  A binding to a library of which nothing was
    captured is NOT_LINKED.
    """
    captured = declarations.select("library").distinct().withColumn("_have", F.lit(True))
    bound = bindings.join(captured, "library", "left")
    missing = bound.where("_have is null").select("binding", F.lit(None).cast(calls.schema["call"].dataType).alias("call"), F.lit(None).cast(declarations.schema["declaration"].dataType).alias("declaration"), F.lit("NOT_LINKED").alias("status"))
    unique = declarations.groupBy("library", F.col("identity").alias("target")).agg(F.count("*").alias("_n"), F.min("declaration").alias("declaration")).where("_n = 1")
    linked = calls.join(bound.where("_have"), "consumer").join(unique, ["library", "target"])
    return linked.select("binding", "call", "declaration", F.lit("CANDIDATE_CONTINUATION").alias("status")).unionByName(missing)


def inherited(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method, base, status) of methods (method, owner, name, arity, overrides) that say they override.

    The supertypes of types (type, supertypes) are followed one step.  INHERITED from the one method of that name and
    arity in them; AMBIGUOUS for several; UNRESOLVED if the owner or a supertype is missing or stands there twice, or no method fits.
    """
    counted = types.groupBy("type").agg(F.count("*").alias("n"), F.first("supertypes").alias("supertypes"))
    known = counted.where("n = 1").select("type", "supertypes")
    over = methods.where("overrides").select("method", "owner", "name", "arity")
    rooted = over.join(known.withColumnRenamed("type", "owner"), "owner", "left")
    bases = rooted.select("method", "name", "arity", F.explode_outer("supertypes").alias("base_type"))
    bases = bases.join(known.select(F.col("type").alias("base_type"), F.lit(True).alias("found")), "base_type", "left")
    declared = methods.select(F.col("owner").alias("base_type"), "name", "arity", F.col("method").alias("base"))
    met = bases.join(declared, ["base_type", "name", "arity"], "left").groupBy("method").agg(F.bool_and(_yes(F.col("found"))).alias("whole"), F.count_distinct("base").alias("n"), F.min("base").alias("base"))
    status = F.when(~F.col("whole") | (F.col("n") == 0), "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("INHERITED")
    return met.select("method", F.when(status == "INHERITED", F.col("base")).alias("base"), status.alias("status"))


def attach_notes(notes: DataFrame, subjects: DataFrame, note: str, targets: str, subject: str) -> DataFrame:
    """(note, attached, missing): the targets of each note that are there, and those that are not, in order."""
    t = notes.select(note, F.explode_outer(targets).alias("t")).distinct()
    met = join_hot(t, subjects.select(F.col(subject).alias("t"), F.lit(True).alias("there")), ["t"], "left")
    some = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("t"))))
    return met.groupBy(note).agg(some(F.col("there")).alias("attached"), some(F.col("there").isNull()).alias("missing"))


def turn_windows(findings: DataFrame, lane: str, anchor: list[str], size: str, finding: str, most: int, budget: int) -> DataFrame:
    """(lane, *anchor, size, n_findings, position): findings with one anchor make one window; lanes take turns, and the
    first window beyond ``most`` or ``budget`` bytes ends the choice."""
    grouped = findings.groupBy(lane, *anchor).agg(F.max(size).alias(size), F.count_distinct(finding).alias("n_findings"))
    turned = grouped.withColumn("_turn", F.row_number().over(Window.partitionBy(lane).orderBy(*anchor))).where(F.col("_turn") <= most)
    first = turned.orderBy("_turn", lane).limit(most)
    order = Window.orderBy("_turn", lane)  # over at most ``most`` rows
    return first.withColumn("position", F.row_number().over(order)).withColumn("_sum", F.sum(size).over(order)).withColumn("_over", F.max((F.col("_sum") > budget).cast("int")).over(order)).where("_over = 0").drop("_turn", "_sum", "_over")


def batch_payloads(selections: DataFrame, order: list[str], payload: str) -> DataFrame:
    """(*order, digest, form): the first of equal payloads is SENT, the others are a REFERENCE to it."""
    rows = selections.select(*order, F.sha2(payload, 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min(F.struct(*order)).alias("_first"))
    same = F.struct(*order) == F.col("_first")
    return join_hot(rows, first, ["digest"], by=order).select(*order, "digest", F.when(same, "SENT").otherwise("REFERENCE").alias("form"))


def references(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """(reference): what the given columns of tables refer to, each once; not followed any further."""
    out = None
    for df, column in tables:
        one = df.select(F.col(column).cast("string").alias("reference")).where("reference is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def attach_local(callables: DataFrame, graphs: DataFrame) -> DataFrame:
    """(callable, graph, status) of callables (callable, owner, graph) with a local graph (graph, owner): ATTACHED, OWNER_DIFFERS, or NONE."""
    g = graphs.select("graph", F.col("owner").alias("_owner"), F.lit(True).alias("_there"))
    out = callables.join(g, "graph", "left")
    status = F.when(F.col("_there").isNull(), "NONE").when(F.col("owner").eqNullSafe(F.col("_owner")), "ATTACHED").otherwise("OWNER_DIFFERS")
    return out.select("callable", F.when(status == "ATTACHED", F.col("graph")).alias("graph"), status.alias("status"))


def recheck(objects: DataFrame, digest: Column, links: DataFrame) -> DataFrame:
    """(object, problem): objects (object, digest) whose content has another digest, and links (object, refers) to none."""
    wrong = objects.where(~F.col("digest").eqNullSafe(digest)).select("object", F.lit("DIGEST_DIFFERS").alias("problem"))
    known = objects.select(F.col("object").alias("refers")).distinct()
    dangling = links.where("refers is not null").join(known, "refers", "left_anti").select("object", F.lit("REFERS_TO_NOTHING").alias("problem"))
    return wrong.unionByName(dangling).distinct()


def context(hits: DataFrame, evidence: DataFrame, size: str, roots: int, budget: int) -> DataFrame:
    """(position, fact_key, n_terms, by_name, size): what hits (term, lane, fact_key, by_alias) found, best first.

    Facts are ranked by the number of their terms, those found by their own name first; the best ``roots`` get their
    evidence (fact_key, size) and are given in order as far as ``budget`` bytes go.
    """
    ranked = hits.groupBy("fact_key").agg(F.count_distinct("term").alias("n_terms"), F.count_distinct(F.when(F.col("by_alias") == 0, F.col("term"))).alias("by_name"))
    best = ranked.join(evidence, "fact_key").orderBy(F.desc("n_terms"), F.desc("by_name"), "fact_key").limit(roots)
    order = Window.orderBy(F.desc("n_terms"), F.desc("by_name"), "fact_key")  # over at most ``roots`` rows
    return best.withColumn("position", F.row_number().over(order)).withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= budget).drop("_sum")
