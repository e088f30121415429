"""Intent queries over knowledge tables: one function per intent, each answer with its supports and what is unknown.

Tables: entities(entity_id, entity_type, name), clauses(clause_id, subject, predicate, object), premises(node, premise) with
clause ids, components(component, member), functions(function_id, provided_by, verb, object_type),
capabilities(capability_id, function_id, requirement_id), requirements(requirement_id, kind, subject, object),
affordances(affordance_id, object_type, capability_id), inventories(subject, inventory): closed-world declarations.
An id is `type/name`; a bare name resolves only if it is the name of exactly one entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import closure, path_between, root_paths


@dataclass
class Knowledge:
    entities: DataFrame
    clauses: DataFrame
    premises: DataFrame
    edges: DataFrame  # child, parent of the kinematic tree
    drivers: DataFrame  # driver, frame that it moves
    components: DataFrame | None = None
    functions: DataFrame | None = None
    capabilities: DataFrame | None = None
    requirements: DataFrame | None = None
    affordances: DataFrame | None = None
    inventories: DataFrame | None = None


def resolve(k: Knowledge, names: DataFrame) -> DataFrame:
    """names (name) with entity_id and state: resolved, ambiguous or unknown."""
    e = k.entities.select("entity_id", F.substring_index("entity_id", "/", -1).alias("_tail"))
    full = names.join(e.select(F.col("entity_id").alias("_full")), F.col("name") == F.col("_full"), "left")
    tails = e.groupBy("_tail").agg(F.count("*").alias("_n"), F.min("entity_id").alias("_one"))
    out = full.join(tails, F.col("name") == F.col("_tail"), "left")
    state = F.when(F.col("_full").isNotNull() | (F.col("_n") == 1), "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return out.select("name", F.when(state == "resolved", F.coalesce("_full", "_one")).alias("entity_id"), state.alias("state"))


def supports(k: Knowledge, clause_ids: DataFrame, settle=None) -> DataFrame:
    """Clauses that the given ones (column node) rest on, themselves included."""
    return closure(k.premises, clause_ids, settle).join(k.clauses, F.col("node") == F.col("clause_id")).drop("node")


def structural_summary(k: Knowledge) -> DataFrame:
    """Number of entities by type, and of leaves and branch points of the tree."""
    from .graphs import degrees

    d = degrees(k.edges).agg(F.count_if("is_leaf").alias("leaf"), F.count_if("is_branch").alias("branch"))
    shape = d.select(F.explode(F.create_map(F.lit("tree_leaf"), "leaf", F.lit("tree_branch"), "branch")).alias("entity_type", "n"))
    return k.entities.groupBy("entity_type").agg(F.count("*").alias("n")).unionByName(shape)


def trace_kinematic_path(k: Knowledge, a: str, b: str) -> DataFrame:
    """up, common, down between two frames; no row if either is not in the tree."""
    return path_between(root_paths(k.edges), a, b)


def explain_driver_effect(k: Knowledge, driver: str) -> DataFrame:
    """Frames that a driver moves, with the clauses that say so."""
    moved = k.drivers.where(F.col("driver") == driver).select("frame")
    return moved.join(k.clauses.where(F.col("predicate") == "moves").where(F.col("subject") == driver), F.col("frame") == F.col("object"), "left").select("frame", "clause_id")


def explain_clauses(k: Knowledge, entity: str, predicate: str | None = None, settle=None) -> DataFrame:
    """Clauses about an entity (a pose law, a constraint) and everything they rest on."""
    own = k.clauses.where((F.col("subject") == entity) | (F.col("object") == entity))
    if predicate:
        own = own.where(F.col("predicate") == predicate)
    return supports(k, own.select(F.col("clause_id").alias("node")), settle)


def describe_entity(k: Knowledge, entity: str) -> DataFrame:
    """The entity's clauses from either side."""
    return k.clauses.where((F.col("subject") == entity) | (F.col("object") == entity)).select("clause_id", "predicate", F.when(F.col("subject") == entity, "subject").otherwise("object").alias("role"), F.when(F.col("subject") == entity, F.col("object")).otherwise(F.col("subject")).alias("other"))


def compare_nodes(nodes: DataFrame, a, b) -> DataFrame:
    """Two configuration nodes (node, component, rank, position): same component, same rank, distance of positions."""
    x = nodes.where(F.col("node") == a).select(F.col("component").alias("ca"), F.col("rank").alias("ra"), F.col("position").alias("pa"))
    y = nodes.where(F.col("node") == b).select(F.col("component").alias("cb"), F.col("rank").alias("rb"), F.col("position").alias("pb"))
    d = F.sqrt(F.aggregate(F.zip_with("pa", "pb", lambda m, n: (m - n) * (m - n)), F.lit(0.0), lambda acc, v: acc + v))
    return x.crossJoin(y).select((F.col("ca") == F.col("cb")).alias("connected"), (F.col("ra") == F.col("rb")).alias("same_rank"), d.alias("distance"))  # one row each


def describe_component(k: Knowledge, component: str) -> DataFrame:
    """Members, and the functions that the component provides."""
    members = k.components.where(F.col("component") == component).select(F.lit("member").alias("kind"), F.col("member").alias("item"))
    return members.unionByName(k.functions.where(F.col("provided_by") == component).select(F.lit("function").alias("kind"), F.col("function_id").alias("item")))


def explain_function(k: Knowledge, function: str) -> DataFrame:
    return k.functions.where(F.col("function_id") == function)


def ground_requirements(k: Knowledge, witnesses: dict[str, DataFrame]) -> DataFrame:
    """Every requirement with met, not_met or unknown. witnesses: per kind the (subject, object) pairs that hold.

    A requirement without a witness is not met only if its subject has a closed inventory of its kind.
    """
    held = None
    for kind, w in witnesses.items():
        part = w.select(F.lit(kind).alias("kind"), "subject", "object")
        held = part if held is None else held.unionByName(part)
    r = k.requirements
    yes = r.join(held.distinct().withColumn("_yes", F.lit(True)), (r.kind == held.kind) & (r.subject == held.subject) & r.object.eqNullSafe(held.object), "left").select(r["*"], "_yes")
    closed = k.inventories.select(F.col("subject").alias("_s"), F.col("inventory").alias("_i"), F.lit(True).alias("_closed")).distinct()
    out = yes.join(closed, (F.col("subject") == F.col("_s")) & (F.col("kind") == F.col("_i")), "left")
    return out.select(*r.columns, F.when(F.col("_yes"), "met").when(F.col("_closed"), "not_met").otherwise("unknown").alias("status"))


def explain_capability(k: Knowledge, grounded: DataFrame) -> DataFrame:
    """Every capability: available if all requirements are met, unavailable if one is not, else unknown."""
    j = k.capabilities.join(grounded.select("requirement_id", "status"), "requirement_id", "left")
    s = j.groupBy("capability_id", "function_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "met").alias("n_met"), F.count_if(F.col("status") == "not_met").alias("n_not"))
    return s.withColumn("state", F.when(F.col("n_not") > 0, "unavailable").when(F.col("n_met") == F.col("n"), "available").otherwise("unknown"))


def can_perform_action(k: Knowledge, grounded: DataFrame, verb: str, object_type: str) -> DataFrame:
    """One row: yes if an available capability serves the verb on the type; no only in a closed function inventory; else unknown."""
    fit = k.functions.where((F.col("verb") == verb) & (F.col("object_type") == object_type))
    c = explain_capability(k, grounded).join(fit.select("function_id", "provided_by"), "function_id")
    closed = k.inventories.where(F.col("inventory") == "functions").agg(F.count("*").alias("n_closed"))
    s = c.agg(F.count_if(F.col("state") == "available").alias("n_available"), F.count_if(F.col("state") == "unknown").alias("n_unknown"), F.array_sort(F.collect_set(F.when(F.col("state") == "available", F.col("capability_id")))).alias("supports"))
    return s.crossJoin(closed).select(F.when(F.col("n_available") > 0, "yes").when((F.col("n_unknown") == 0) & (F.col("n_closed") > 0), "no").otherwise("unknown").alias("answer"), F.array_join("supports", ",").alias("supports"))  # one row each


def what_is_entity_for(k: Knowledge, entity: str) -> DataFrame:
    """Functions of the components that hold the entity, or of the entity itself."""
    owners = k.components.where(F.col("member") == entity).select(F.col("component").alias("provided_by")).unionByName(k.entities.where(F.col("entity_id") == entity).select(F.col("entity_id").alias("provided_by"))).distinct()
    return k.functions.join(owners, "provided_by").select("function_id", "verb", "object_type", "provided_by")


def explain_affordance(k: Knowledge, grounded: DataFrame, object_type: str) -> DataFrame:
    """What may be done with a type of object, by the state of the capabilities behind it."""
    return k.affordances.where(F.col("object_type") == object_type).join(explain_capability(k, grounded).select("capability_id", "state"), "capability_id", "left")


def why_not_ready(truths: DataFrame, wanted: Column) -> DataFrame:
    """Conditions of an action that are not as wanted, with their reasons."""
    return truths.where(~F.coalesce(wanted, F.lit(False))).select("condition_id", "truth", "reason")


# Action assurance: tables of any number of actions.


@dataclass
class Assurance:
    """truths(action, condition_id, role precondition or effect, wanted, truth, reason, evidence_time, record_id), lifecycle(action, status,
    last_state, running_from), records(action, record_id, observed_at, state)."""

    truths: DataFrame
    lifecycle: DataFrame
    records: DataFrame

    @property
    def met(self) -> Column:
        return F.col("truth") == F.when(F.col("wanted"), "true").otherwise("false")

    def relation(self) -> DataFrame:
        """truths with `relation`: before_start, after_start or not_started of the evidence against the first execution time."""
        j = self.truths.join(self.lifecycle.select("action", "running_from"), "action", "left")
        return j.withColumn("relation", F.when(F.col("evidence_time").isNull(), "no_evidence").when(F.col("running_from").isNull(), "not_started").when(F.col("evidence_time") < F.col("running_from"), "before_start").otherwise("after_start"))


def summarize_action(a: Assurance) -> DataFrame:
    """action, status, readiness, n_preconditions, n_met, n_effects, n_observed, outcome."""
    from .evidence import outcome

    t, pre, eff = a.relation().withColumn("_met", F.coalesce(a.met, F.lit(False))), F.col("role") == "precondition", F.col("role") == "effect"
    sums = t.groupBy("action").agg(
        F.count_if(pre).alias("n_preconditions"), F.count_if(pre & F.col("_met")).alias("n_met"), F.count_if(pre & (F.col("truth") == "unknown")).alias("_u"),
        F.count_if(eff).alias("n_effects"), F.count_if(eff & F.col("_met")).alias("n_observed"), F.count_if(eff & F.col("_met") & (F.col("relation") == "before_start")).alias("_before"),
    )
    ready = F.when(F.col("n_met") == F.col("n_preconditions"), "ready").when(F.col("n_met") + F.col("_u") < F.col("n_preconditions"), "not_ready").otherwise("unknown")
    j = sums.join(a.lifecycle.select("action", "status"), "action", "left").withColumn("status", F.coalesce("status", F.lit("no_records")))
    return j.select("action", "status", ready.alias("readiness"), "n_preconditions", "n_met", "n_effects", "n_observed", outcome(F.col("status"), F.col("n_effects"), F.col("n_observed"), F.col("_before")).alias("outcome"))


def explain_precondition(a: Assurance) -> DataFrame:
    """Every precondition with what was wanted, what was found, and why."""
    return a.truths.where("role = 'precondition'").select("action", "condition_id", "wanted", "truth", "reason", F.coalesce(a.met, F.lit(False)).alias("met"))


def explain_effect(a: Assurance) -> DataFrame:
    """Every effect with its relation to the start of execution; evidence from before it proves nothing."""
    return a.relation().where("role = 'effect'").select("action", "condition_id", "truth", "relation", (F.coalesce(a.met, F.lit(False)) & (F.col("relation") == "after_start")).alias("attributable"))


def explain_evidence(a: Assurance) -> DataFrame:
    """Every record that a condition's truth rests on: action, record_id, observed_at, how many conditions rest on it, and their ids."""
    used = a.truths.where("record_id is not null").groupBy("action", "record_id").agg(F.array_sort(F.collect_set("condition_id")).alias("c"))
    return a.records.join(used, ["action", "record_id"]).select("action", "record_id", "observed_at", F.size("c").cast("long").alias("n_conditions"), F.array_join("c", ",").alias("conditions"))


def explain_lifecycle(a: Assurance) -> DataFrame:
    """Every change of state with whether it is allowed."""
    from .evidence import transitions

    return transitions(a.records, ["action"], "observed_at", "record_id", "state").select("action", "record_id", "before", "after", "allowed")


def two_layer_closure(functional: DataFrame, structural: DataFrame, links: DataFrame, seeds: DataFrame, settle=None) -> DataFrame:
    """(layer, node): what the seeds rest on among functional premises (node, premise), what those stand for (links: node, premise), and what
    that rests on among structural premises."""
    upper = closure(functional, seeds, settle)
    lower = closure(structural, upper.join(links, "node").select(F.col("premise").alias("node")), settle)
    return upper.select(F.lit("functional").alias("layer"), "node").unionByName(lower.select(F.lit("structural").alias("layer"), "node"))


def compile_issues(k: Knowledge) -> DataFrame:
    """(table, id, issue) of a functional model: repeated ids, and references that nothing declares."""
    twice = lambda df, name, key: df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table"), "id", F.lit("repeated_id").alias("issue"))

    def loose(df: DataFrame, name: str, key: str, column: str, known: DataFrame) -> DataFrame:
        ids = known.select(known.columns[0]).distinct().toDF("_k")
        return df.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_k"), "left_anti").select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), F.lit(f"unknown_{column}").alias("issue")).distinct()

    owners = k.components.select("component").unionByName(k.entities.select(F.col("entity_id").alias("component")))
    parts = [
        twice(k.functions, "functions", "function_id"), twice(k.affordances, "affordances", "affordance_id"), loose(k.components, "components", "component", "member", k.entities.select("entity_id")),
        loose(k.functions, "functions", "function_id", "provided_by", owners), loose(k.capabilities, "capabilities", "capability_id", "function_id", k.functions.select("function_id")),
        loose(k.capabilities, "capabilities", "capability_id", "requirement_id", k.requirements.select("requirement_id")), loose(k.affordances, "affordances", "affordance_id", "capability_id", k.capabilities.select("capability_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_entities(declared: DataFrame) -> DataFrame:
    """declared (entity_id, types, name) to one row per entity: all its types, sorted, and the least name."""
    types = declared.select("entity_id", F.explode_outer("types").alias("t")).groupBy("entity_id").agg(F.array_sort(F.collect_set("t")).alias("types"))
    return types.join(declared.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("n_declared")), "entity_id")


def trace_clause_path(k: Knowledge, a: str, b: str, predicate: str) -> DataFrame:
    """step, node, clause_id: the way from one entity to another over clauses of a predicate that points upwards, each step with its clause."""
    own = k.clauses.where(F.col("predicate") == predicate)
    tops = own.select(F.col("object").alias("child")).distinct().join(own.select(F.col("subject").alias("child")), "child", "left_anti").select("child", F.lit(None).cast("string").alias("parent"))
    way = path_between(root_paths(own.select(F.col("subject").alias("child"), F.col("object").alias("parent")).unionByName(tops)), a, b)
    nodes = way.select(F.posexplode(F.concat("up", F.array("common"), "down")).alias("step", "node"), F.size("up").alias("_up"))
    # a step up is the clause of the node it leaves, a step down that of the node it reaches
    return nodes.join(own.select(F.col("subject").alias("node"), "clause_id"), "node", "left").select("step", "node", F.when(F.col("step") != F.col("_up"), F.col("clause_id")).alias("clause_id"))
