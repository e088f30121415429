"""Task specifications: roles, predicates, goal and failure expressions, evaluated over all runs in one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..operators.predicates import LEAVES, PASSES, Episode, composite

COMPOSITES = {t for p in PASSES[1:] for t in p}


def validate_expression(tree, known: set[str]) -> None:
    """Exactly one operator per node, no empty lists, only known predicates."""
    if not isinstance(tree, dict) or len(tree) != 1:
        raise ValueError("an expression has exactly one operator")
    (kind, body), = tree.items()
    if kind == "predicate":
        if body not in known:
            raise ValueError(f"unknown predicate {body}")
    elif kind == "not":
        validate_expression(body, known)
    elif kind in ("all", "any"):
        if not isinstance(body, list) or not body:
            raise ValueError(f"{kind} needs a list that is not empty")
        for x in body:
            validate_expression(x, known)
    else:
        raise ValueError(f"unknown operator {kind}")


@dataclass
class Task:
    task_id: str
    predicates: list[dict]
    goal: dict
    failure: dict | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ids = [p["id"] for p in self.predicates]
        if len(set(ids)) != len(ids):
            raise ValueError("predicate ids repeat")
        for p in self.predicates:
            if p["type"] not in LEAVES and p["type"] not in COMPOSITES:
                raise ValueError(f"unknown predicate type {p['type']}")
        validate_expression(self.goal, set(ids))
        if self.failure is not None:
            validate_expression(self.failure, set(ids))

    @classmethod
    def load(cls, path: str) -> Task:
        """From a JSON file, or YAML where the library is there."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        if "entities" in raw or any("parameters" in p for p in raw.get("predicates", [])):
            return cls.from_document(raw)
        unknown = set(raw) - {"task_id", "predicates", "goal", "failure", "roles"}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**raw)

    @classmethod
    def from_document(cls, raw: dict) -> Task:
        """From the document form: predicate_id, type, window and parameters per predicate, names with units, bare names in expressions."""
        return cls(raw["task_id"], [_predicate(p) for p in raw["predicates"]], _tree(raw["goal"]), _tree(raw["failure"]) if raw.get("failure") else None, dict(raw.get("entities", {})))


def _tree(x):
    if isinstance(x, str):
        return {"predicate": x}
    (kind, body), = x.items()
    return {kind: [_tree(y) for y in body] if isinstance(body, list) else body if kind == "predicate" else _tree(body)}


# The document form's parameter names and this module's.
_NAMES = {
    "max_sample_age_s": "max_age_s",
    "minimum_normal_force_n": "minimum_force_n",
    "minimum_m": "height_m",
    "minimum_delta_m": "delta_m",
    "position_tolerance_m": "position_tolerance",
    "tolerance_m": "tolerance",
    "orientation_tolerance_rad": "rotation_tolerance",
    "maximum_abs_velocity": "maximum",
    "maximum_linear_speed_mps": "linear",
    "maximum_angular_speed_radps": "angular",
    "maximum_lateral_error_m": "lateral_tolerance_m",
    "maximum_point_error_m": "maximum_tolerance_m",
    "expected_keypoints_m": "expected",
    "allowed_pairs": "allowed",
    "ignored_pairs": "ignored",
    "contact_predicate": "contact",
    "contact_predicates": "contacts",
    "gripper_predicate": "gripper",
    "follows_predicate": "follows",
    "lift_predicate": "lifted",
    "inside_predicate": "inside",
}
_SHAPES = {"min_m": "minimum", "max_m": "maximum", "center_m": "center", "radius_m": "radius", "points_m": "points"}


def _predicate(p: dict) -> dict:
    given = dict(p.get("parameters", {}))
    out = {_NAMES.get(k, k): v for k, v in given.items()}
    out |= {"id": p["predicate_id"], "type": p["type"], **{k: v for k, v in p.get("window", {}).items() if k in ("start_s", "end_s")}}
    for k in ("region", "corridor"):
        if k in out:
            out[k] = {_SHAPES.get(a, a): b for a, b in out[k].items()}
    if "pair" in out:
        out["body_a"], out["body_b"] = out.pop("pair")
    kind = p["type"]
    if kind == "object_follows_frame_for_duration":
        out["frame"], out["entity"] = out.pop("reference"), out.pop("target")
        if expected := out.pop("expected_relative_pose", None):
            out["expected_position"], out["expected_quaternion"] = expected["position_m"], expected["quaternion_xyzw"]
    elif kind in ("frame_within_pose_tolerance", "base_reached_goal", "frame_position_within_tolerance"):
        out["entity"] = out.pop("frame", out.get("entity"))
        target = out.pop("target", {})
        if "entity" in target:
            out["reference"] = target["entity"]
        else:
            out["position"], out["quaternion"] = target.get("position_m"), target.get("quaternion_xyzw")
        if kind == "frame_position_within_tolerance" and "position_tolerance" in out:
            out["tolerance"] = out.pop("position_tolerance")
    elif kind in ("frame_position_in_bounds", "frame_velocity_below_threshold") and "frame" in out:
        out["entity"] = out.pop("frame")
    elif kind == "inserted_to_depth":
        out["entity"] = out.pop("target", out.get("entity"))
    elif kind == "joint_position_in_range" and "ranges" in out:
        out["ranges"] = {j: tuple(r) for j, r in out["ranges"].items()}
    if kind == "object_grasped" and "contact" in out:
        out["contacts"] = [out.pop("contact")]
    return out


def evaluate(task: Task, episode: Episode) -> DataFrame:
    """One row per run of the task: run_id, one status column per predicate, goal, failure and verdict."""
    runs = episode.runs.where(F.col("task_id") == task.task_id) if "task_id" in episode.runs.columns else episode.runs
    ep = Episode(runs, episode.tables, {**episode.roles, **task.roles}, episode.flags)
    rows = None
    for p in task.predicates:
        if p["type"] in LEAVES:
            part = LEAVES[p["type"]](ep, p).select("run_id", F.lit(p["id"]).alias("predicate_id"), "status")
            rows = part if rows is None else rows.unionByName(part)
    leaves = [p["id"] for p in task.predicates if p["type"] in LEAVES]
    wide = runs.select("run_id") if rows is None else runs.select("run_id").join(rows.groupBy("run_id").agg(*[F.max(F.when(F.col("predicate_id") == i, F.col("status"))).alias(i) for i in leaves]), "run_id", "left")
    statuses = {i: F.coalesce(F.col(i), F.lit(S.UNKNOWN)) for i in leaves}
    for types in PASSES[1:]:
        for p in task.predicates:
            if p["type"] in types:
                wide = wide.withColumn(p["id"], composite(p, statuses))
                statuses = {**statuses, p["id"]: F.col(p["id"])}
    goal = S.expression(task.goal, statuses)
    failure = S.expression(task.failure, statuses) if task.failure is not None else F.lit(None).cast("string")
    return wide.withColumn("goal", goal).withColumn("failure", failure).withColumn("verdict", S.verdict(F.col("goal"), F.col("failure") if task.failure is not None else None))


def results(evaluated: DataFrame, task: Task) -> DataFrame:
    """(run_id, predicate_id, type, status) rows of evaluate()'s table."""
    each = F.array(*[F.struct(F.lit(p["id"]).alias("predicate_id"), F.lit(p["type"]).alias("type"), F.col(p["id"]).alias("status")) for p in task.predicates])
    return evaluated.select("run_id", F.explode(each).alias("r")).select("run_id", "r.*")


def confirmed(verdict: str) -> str:
    """The report's word for a verdict."""
    return {S.SUPPORTED: "confirmed"}.get(verdict, verdict)


def report(row: dict, task: Task) -> str:
    """A run's row as Markdown."""
    lines = [f"# {task.task_id}: {row['run_id']}", "", f"Verdict: {confirmed(row['verdict'])} (goal {row['goal']})", "", "| predicate | type | status |", "| --- | --- | --- |"]
    return "\n".join([*lines, *[f"| {p['id']} | {p['type']} | {row[p['id']]} |" for p in task.predicates]]) + "\n"
