"""Task predicates over sampled streams: one plan per predicate type for all runs and all predicates of that type.

Tables (any number of runs):

    runs(run_id, start_s, end_s, timestep_s, task_id, measurements MAP<STRING, DOUBLE>)
    joint_state(run_id, sample_index, time_s, joint_id, position, velocity, effort)
    pose, odometry(run_id, sample_index, time_s, entity_id, position ARRAY<DOUBLE>, quaternion ARRAY<DOUBLE>, linear_velocity, angular_velocity)
    contact(run_id, sample_index, time_s, body_a, body_b, active, normal_force_n, force_n ARRAY<DOUBLE>)
    collision(run_id, sample_index, time_s, body_a, body_b, active)
    force_torque(run_id, sample_index, time_s, sensor_id, force_n, torque_nm)
    deformable(run_id, sample_index, time_s, entity_id, keypoints ARRAY<ARRAY<DOUBLE>>)

A compiler takes an Episode (the tables, issue flags, and the task's roles) and one specification, and gives
(run_id, status, reason). Missing evidence is unknown, never false. Positive witnesses are accepted from incomplete
streams; universal and negative claims need complete ones. Null = absent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import vec as V
from .temporal import islands

#: Issues that make a channel's evidence conflicting, and those that make it incomplete.
CONFLICT_ISSUES = ("invalid_time", "out_of_order", "conflicting_duplicate", "invalid_quaternion")
INCOMPLETE_ISSUES = ("no_samples", "gap", "incomplete_start_coverage", "incomplete_end_coverage", "missing_values")
CHANNELS = ("joint_state", "pose", "odometry", "contact", "collision", "force_torque", "deformable")
_IDENTITY = {"contact": ("body_a", "body_b"), "collision": ("body_a", "body_b")}
_ENTITY = {"joint_state": "joint_id", "pose": "entity_id", "odometry": "entity_id", "force_torque": "sensor_id", "deformable": "entity_id"}
_PAYLOAD = {
    "joint_state": ("position", "velocity", "effort"),
    "pose": ("position", "quaternion"),
    "odometry": ("position", "quaternion"),
    "contact": ("active", "normal_force_n"),
    "collision": ("active",),
    "force_torque": ("force_n", "torque_nm"),
    "deformable": ("keypoints",),
}


def channel_issues(runs: DataFrame, rows: DataFrame, channel: str, max_gap: Column | None = None) -> DataFrame:
    """(run_id, channel, issue, sample_index) of one channel: order, duplicates, gaps, coverage and holes.

    Samples of a channel share a time; checks run over samples, duplicates over rows of one entity or pair. A sample that
    lacks an entity which other samples have is a hole (missing_values). Default max_gap: 2.5 time steps.
    """
    gap = F.col("timestep_s") * 2.5
    if max_gap is not None:
        gap = max_gap
    elif "max_gap" in runs.columns:
        gap = F.coalesce(F.col("max_gap")[channel], gap)
    own = runs.select("run_id", "start_s", "end_s", gap.alias("_gap"))
    samples = rows.groupBy("run_id", "sample_index").agg(F.min("time_s").alias("time_s"))
    w = W.partitionBy("run_id").orderBy("sample_index")
    ordered = samples.join(own, "run_id").withColumn("_before", F.lag("time_s").over(w))
    order = ordered.select("run_id", "sample_index", F.explode(F.filter(F.array(
        F.when(F.col("time_s").isNull() | F.isnan("time_s") | (F.col("time_s") < 0), F.lit("invalid_time")),
        F.when(F.col("time_s") < F.col("_before"), F.lit("out_of_order")),
        F.when(F.col("time_s") - F.col("_before") > F.col("_gap"), F.lit("gap")),
    ), lambda x: x.isNotNull())).alias("issue"))
    ends = own.join(samples.groupBy("run_id").agg(F.min_by("time_s", "sample_index").alias("first"), F.max_by("time_s", "sample_index").alias("last")), "run_id", "left")
    cover = ends.select("run_id", F.lit(None).cast("int").alias("sample_index"), F.explode(F.filter(F.array(
        F.when(F.col("first").isNull(), F.lit("no_samples")),
        F.when(F.col("first") > F.col("start_s") + F.col("_gap"), F.lit("incomplete_start_coverage")),
        F.when(F.col("last") < F.col("end_s") - F.col("_gap"), F.lit("incomplete_end_coverage")),
    ), lambda x: x.isNotNull())).alias("issue"))
    keys = _IDENTITY.get(channel) or (_ENTITY[channel],)
    payload = _PAYLOAD[channel]
    e = W.partitionBy("run_id", *keys).orderBy("sample_index")
    before = F.lag(F.struct("time_s", *payload)).over(e)
    same = F.lit(False)
    for c in payload:
        same = same | ~F.col(c).eqNullSafe(F.col("_b").getField(c))
    double = rows.withColumn("_b", before).where((F.col("time_s") == F.col("_b.time_s")) & same).select("run_id", "sample_index", F.lit("conflicting_duplicate").alias("issue"))
    parts = [order, cover, double]
    if channel in _ENTITY:
        value = payload[0]
        present = rows.groupBy("run_id", _ENTITY[channel]).agg(F.count(value).alias("k"))
        total = samples.groupBy("run_id").agg(F.count("*").alias("n"))
        holes = present.join(total, "run_id").where("k > 0 and k < n").select("run_id", F.lit(None).cast("int").alias("sample_index"), F.lit("missing_values").alias("issue"))
        parts.append(holes)
    if channel in ("pose", "odometry"):
        bad = rows.where(F.col("quaternion").isNotNull() & ~(V.norm(F.col("quaternion"), 4) > 1e-12))
        parts.append(bad.select("run_id", "sample_index", F.lit("invalid_quaternion").alias("issue")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("run_id", F.lit(channel).alias("channel"), "issue", F.col("sample_index").cast("int"))


def channel_flags(runs: DataFrame, issues: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(run_id, channel, status, conflicting, incomplete): invalid, incomplete or complete; a channel without any rows is absent and `missing`."""
    grid = declared if declared is not None else runs.select("run_id", F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("channel"))
    sums = issues.groupBy("run_id", "channel").agg(F.bool_or(F.col("issue").isin(*CONFLICT_ISSUES)).alias("conflicting"), F.bool_or(F.col("issue").isin(*INCOMPLETE_ISSUES)).alias("incomplete"), F.bool_or(F.col("issue") == "no_samples").alias("missing"))
    out = grid.join(sums, ["run_id", "channel"], "left").fillna(False, ["conflicting", "incomplete", "missing"])
    return out.withColumn("status", F.when(F.col("conflicting"), "invalid").when(F.col("incomplete"), "incomplete").otherwise("complete"))


@dataclass
class Episode:
    """Tables of many runs, and the flags of their channels."""

    runs: DataFrame
    tables: dict[str, DataFrame]
    roles: dict[str, str] = field(default_factory=dict)
    flags: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.flags is None:
            issues = None
            for c, rows in self.tables.items():
                part = channel_issues(self.runs, rows, c)
                issues = part if issues is None else issues.unionByName(part)
            declared = self.runs.select("run_id", F.explode(F.array(*[F.lit(c) for c in self.tables])).alias("channel"))
            if "channels" in self.runs.columns:  # of a run, those that it has
                issues = issues.join(self.runs.select("run_id", F.explode("channels").alias("channel")).withColumn("_there", F.lit(True)), ["run_id", "channel"], "left").where("_there or issue = 'no_samples'").drop("_there")
            self.flags = channel_flags(self.runs, issues, declared)

    def entity(self, name: str) -> str:
        return self.roles.get(name, name)

    def rows(self, channel: str, spec: dict) -> DataFrame:
        """Rows in the spec's closed window (default: the run's interval), with the run's columns."""
        own = self.runs.select("run_id", "start_s", "end_s", "timestep_s", "measurements")
        lo, hi = F.lit(spec.get("start_s")).cast("double"), F.lit(spec.get("end_s")).cast("double")
        timed = own.withColumn("_lo", F.coalesce(lo, "start_s")).withColumn("_hi", F.coalesce(hi, "end_s"))
        return self.tables[channel].join(timed, "run_id").where(F.col("time_s").between(F.col("_lo"), F.col("_hi")))

    def number(self, x) -> Column:
        """A literal or {measurement, scale, offset} of the run."""
        if isinstance(x, dict):
            return F.col("measurements")[x["measurement"]] * float(x.get("scale", 1.0)) + float(x.get("offset", 0.0))
        return F.lit(float(x))

    def guarded(self, channel: str, judged: DataFrame | None | bool, continuous: bool = False, late: dict[str, str] | None = None) -> DataFrame:
        """(run_id, status, reason) for every run: issue flags first, then what was judged.

        continuous: an incomplete channel is unknown at once. late: statuses that an incomplete channel turns into unknown
        after the data was looked at, with the reason.
        """
        out = self.runs.select("run_id")
        if channel not in self.tables:
            return out.select("run_id", F.lit(S.UNKNOWN).alias("status"), F.lit("channel_missing").alias("reason"))
        flags = self.flags.where(F.col("channel") == channel).select("run_id", "conflicting", "incomplete", "missing")
        out = out.join(flags, "run_id", "left").join(judged, "run_id", "left")
        status = F.when(F.col("missing"), S.UNKNOWN).when(F.col("conflicting"), S.CONFLICTING)
        reason = F.when(F.col("missing"), "channel_missing").when(F.col("conflicting"), "channel_conflicting")
        if continuous:
            status, reason = status.when(F.col("incomplete"), S.UNKNOWN), reason.when(F.col("incomplete"), "channel_incomplete")
        for s, why in (late or {}).items():
            hit = F.col("incomplete") & (F.col("judged") == s)
            status, reason = status.when(hit, S.UNKNOWN), reason.when(hit, why)
        return out.select("run_id", status.otherwise(F.coalesce("judged", F.lit(S.UNKNOWN))).alias("status"), reason.otherwise(F.when(F.col("judged").isNull(), "no_evidence").otherwise(F.coalesce("why", F.lit("observed")))).alias("reason"))


def _verdict(ok: Column) -> Column:
    """supported, refuted, or unknown for a null."""
    return F.when(ok, S.SUPPORTED).when(~ok, S.REFUTED).otherwise(S.UNKNOWN)


def _terminal(rows: DataFrame, spec: dict, keys: list[str], carry: list[str]) -> DataFrame:
    """Last row of each key by sample index, and whether it is stale: older than max_age_s (2.5 time steps) at the window's end."""
    age = F.lit(spec.get("max_age_s")).cast("double")
    last = rows.groupBy("run_id", *keys).agg(F.max_by(F.struct("time_s", "sample_index", "_hi", "timestep_s", "measurements", *carry), "sample_index").alias("l"))
    out = last.select("run_id", *keys, "l.*")
    return out.withColumn("_stale", F.col("_hi") - F.col("time_s") > F.coalesce(age, F.col("timestep_s") * 2.5))


def _judge(rows: DataFrame, ok: Column) -> DataFrame:
    stale = F.col("_stale")
    return rows.select("run_id", F.when(stale, S.UNKNOWN).otherwise(_verdict(ok)).alias("judged"), F.when(stale, "stale").otherwise(F.lit(None).cast("string")).alias("why"))


def _joints(ep: Episode, spec: dict, wanted: dict, value: str, ok: Callable[[Column], Column], fold=F.bool_and) -> DataFrame:
    """All wanted joints' terminal values: a joint without a row or value makes it unknown, a stale one too."""
    names = [ep.entity(j) for j in wanted]
    pairs = ep.runs.sparkSession.createDataFrame([(ep.entity(j), *map(float, x)) for j, x in wanted.items()], "joint_id string, a double, b double")
    last = _terminal(ep.rows("joint_state", spec).where(F.col("joint_id").isin(*names)), spec, ["joint_id"], [value])
    rows = last.join(F.broadcast(pairs), "joint_id").withColumn("_ok", ok(F.col(value)))
    sums = rows.groupBy("run_id").agg(F.count_if(F.col(value).isNotNull()).alias("n"), F.bool_or("_stale").alias("_stale"), F.bool_and("_ok").alias("_all"))
    return _judge(sums, F.when(F.col("n") == len(names), F.col("_all")))


def joint_within_tolerance(ep: Episode, spec: dict) -> DataFrame:
    tol = spec.get("tolerance", 1e-3)
    return ep.guarded("joint_state", "joint_state" in ep.tables and _joints(ep, spec, {j: (t, tol) for j, t in spec["targets"].items()}, "position", lambda v: F.abs(v - F.col("a")) <= F.col("b")))


def joint_position_in_range(ep: Episode, spec: dict) -> DataFrame:
    return ep.guarded("joint_state", "joint_state" in ep.tables and _joints(ep, spec, spec.get("ranges") or {spec["joint"]: (spec["minimum"], spec["maximum"])}, "position", lambda v: v.between(F.col("a"), F.col("b"))))


def joint_velocity_below_threshold(ep: Episode, spec: dict) -> DataFrame:
    return ep.guarded("joint_state", "joint_state" in ep.tables and _joints(ep, spec, {j: (spec["maximum"], 0) for j in spec["joints"]}, "velocity", lambda v: F.abs(v) <= F.col("a")))


def _pose(ep: Episode, spec: dict, entity: str, channel: str = "pose") -> DataFrame:
    return ep.rows(channel, spec).where((F.col("entity_id") == ep.entity(entity)) & F.col("position").isNotNull())


def _with_reference(ep: Episode, spec: dict, rows: DataFrame, name: str | None, channel: str = "pose") -> DataFrame:
    """rows joined with another entity's pose at the same sample (ref_p, ref_q)."""
    if name is None:
        return rows
    ref = ep.tables[channel].where((F.col("entity_id") == ep.entity(name)) & F.col("position").isNotNull()).select("run_id", "sample_index", F.col("position").alias("ref_p"), F.col("quaternion").alias("ref_q"))
    return rows.join(ref, ["run_id", "sample_index"])


def _terminal_pose(ep: Episode, spec: dict, channel: str = "pose", extra: tuple[str, ...] = ()) -> DataFrame:
    rows = _with_reference(ep, spec, _pose(ep, spec, spec["entity"], channel), spec.get("reference"), channel)
    refs = ["ref_p", "ref_q"] if spec.get("reference") else []
    return _terminal(rows, spec, [], ["position", "quaternion", *extra, *refs])


def frame_within_pose_tolerance(ep: Episode, spec: dict, channel: str = "pose") -> DataFrame:
    """Position and, if asked, rotation against a literal target or another entity's pose."""
    if channel not in ep.tables:
        return ep.guarded(channel, None)
    rows = _terminal_pose(ep, spec, channel)
    p = F.col("ref_p") if spec.get("reference") else V.vec(*spec["position"])
    ok = V.distance(F.col("position"), p) <= spec["position_tolerance"]
    if spec.get("rotation_tolerance") is not None:
        q = F.col("ref_q") if spec.get("reference") else V.vec(*spec["quaternion"])
        ok = ok & (V.angle(F.col("quaternion"), q) <= spec["rotation_tolerance"])
    return ep.guarded(channel, _judge(rows, ok))


def base_reached_goal(ep: Episode, spec: dict) -> DataFrame:
    return frame_within_pose_tolerance(ep, spec, "odometry" if "odometry" in ep.tables else "pose")


def frame_position_within_tolerance(ep: Episode, spec: dict) -> DataFrame:
    """Some axes only; the bound is exclusive on demand."""
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _terminal_pose(ep, spec)
    axes = ["xyz".index(a) for a in spec.get("axes", "xyz")]
    p = F.col("ref_p") if spec.get("reference") else V.vec(*spec["position"])
    parts = [(F.col("position")[i] - p[i]) * (F.col("position")[i] - p[i]) for i in axes]
    d = F.sqrt(sum(parts[1:], parts[0]))
    return ep.guarded("pose", _judge(rows, d < spec["tolerance"] if spec.get("exclusive") else d <= spec["tolerance"]))


def frame_position_in_bounds(ep: Episode, spec: dict) -> DataFrame:
    """bounds: axis -> {minimum, maximum, inclusive}; in the reference's frame if there is one. Bounds may be measurements."""
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _terminal_pose(ep, spec)
    p = V.relative_position(F.col("ref_p"), F.col("ref_q"), F.col("position")) if spec.get("reference") else F.col("position")
    ok = F.lit(True)
    for axis, b in spec["bounds"].items():
        x, closed = p["xyz".index(axis)], b.get("inclusive", True)
        if b.get("minimum") is not None:
            m = ep.number(b["minimum"])
            ok = ok & (x >= m if closed else x > m)
        if b.get("maximum") is not None:
            m = ep.number(b["maximum"])
            ok = ok & (x <= m if closed else x < m)
    return ep.guarded("pose", _judge(rows, ok))


def frame_velocity_below_threshold(ep: Episode, spec: dict) -> DataFrame:
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _terminal_pose(ep, spec, extra=("linear_velocity", "angular_velocity"))
    ok = F.lit(True)
    for name in ("linear", "angular"):
        if spec.get(name) is not None:
            ok = ok & (V.norm(F.col(f"{name}_velocity")) <= spec[name])
    return ep.guarded("pose", _judge(rows, ok))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))


def _pair_is(ep: Episode, spec: dict) -> Column:
    x, y = sorted((ep.entity(spec["body_a"]), ep.entity(spec["body_b"])))
    return (F.least("body_a", "body_b") == x) & (F.greatest("body_a", "body_b") == y)


def collision_free_over_interval(ep: Episode, spec: dict) -> DataFrame:
    """No active pair but the exempt ones. A witness refutes at once; freedom needs a complete channel."""
    if "collision" not in ep.tables:
        return ep.guarded("collision", None)
    rows = ep.rows("collision", spec).where(F.col("active"))
    exempt = [tuple(sorted((ep.entity(a), ep.entity(b)))) for a, b in [*spec.get("allowed", []), *spec.get("ignored", [])]]
    if exempt:
        pairs = ep.runs.sparkSession.createDataFrame(exempt, "x string, y string")
        rows = rows.withColumn("x", F.least("body_a", "body_b")).withColumn("y", F.greatest("body_a", "body_b")).join(F.broadcast(pairs), ["x", "y"], "left_anti")
    hits = rows.groupBy("run_id").agg(F.count("*").alias("n"))
    judged = ep.runs.select("run_id").join(hits, "run_id", "left").select("run_id", F.when(F.col("n") > 0, S.REFUTED).otherwise(S.SUPPORTED).alias("judged"), F.lit(None).cast("string").alias("why"))
    return ep.guarded("collision", judged, late={S.SUPPORTED: "channel_incomplete"})


def _sustained(ep: Episode, rows: DataFrame, ok: Column, minimum: float, end_row: bool) -> DataFrame:
    """Longest run of ok rows against a duration; with none asked for: the last row (end_row) or any row."""
    if minimum > 0:
        best = islands(rows, ["run_id"], ["sample_index"], "time_s", ok).groupBy("run_id").agg(F.max("duration").alias("d"))
        return rows.select("run_id").distinct().join(best, "run_id", "left").select("run_id", _verdict(F.coalesce(F.col("d") >= minimum, F.lit(False))).alias("judged"), F.lit(None).cast("string").alias("why"))
    value = F.max_by(F.coalesce(ok, F.lit(False)), "sample_index") if end_row else F.bool_or(F.coalesce(ok, F.lit(False)))
    return rows.groupBy("run_id").agg(value.alias("o")).select("run_id", _verdict(F.col("o")).alias("judged"), F.lit(None).cast("string").alias("why"))


def contact_sustained(ep: Episode, spec: dict) -> DataFrame:
    """A missing force passes unless a force is asked for, then an active row without one is unknown (unless a witness stands)."""
    if "contact" not in ep.tables:
        return ep.guarded("contact", None)
    rows = ep.rows("contact", spec).where(_pair_is(ep, spec))
    least = float(spec.get("minimum_force_n", 0.0))
    ok = F.col("active") & (F.coalesce(F.col("normal_force_n") >= least, F.lit(least <= 0)))
    judged = _sustained(ep, rows, ok, float(spec.get("minimum_duration_s", 0.0)), False)
    if least > 0:
        blind = rows.where(F.col("active") & F.col("normal_force_n").isNull()).select("run_id").distinct().withColumn("_blind", F.lit(True))
        judged = judged.join(blind, "run_id", "left").select("run_id", F.when(F.col("_blind") & (F.col("judged") == S.REFUTED), S.UNKNOWN).otherwise(F.col("judged")).alias("judged"), F.when(F.col("_blind") & (F.col("judged") == S.REFUTED), "force_missing").alias("why"))
    return ep.guarded("contact", judged, late={S.REFUTED: "channel_incomplete"})


def contact_force_at_terminal(ep: Episode, spec: dict) -> DataFrame:
    """The pair's last row: active, force, and if asked its direction within a cone about an axis of an entity's frame at the same time."""
    if "contact" not in ep.tables:
        return ep.guarded("contact", None)
    rows = _terminal(ep.rows("contact", spec).where(_pair_is(ep, spec)), spec, [], ["active", "normal_force_n", "force_n"])
    ok = F.col("active") & (F.col("normal_force_n") >= float(spec.get("minimum_force_n", 0.0)))
    if spec.get("axis") is not None:
        axis = V.vec(*spec["axis"])
        if spec.get("reference"):
            ref = ep.tables["pose"].where(F.col("entity_id") == ep.entity(spec["reference"])).select("run_id", F.col("time_s").alias("_t"), F.col("sample_index").alias("_i"), "quaternion")
            near = rows.select("run_id", "time_s").join(ref, "run_id").where(F.abs(F.col("time_s") - F.col("_t")) <= 1e-12)
            near = near.groupBy("run_id").agg(F.max_by("quaternion", "_i").alias("_q"))
            rows = rows.join(near, "run_id", "left")
            axis = V.rotate(F.col("_q"), axis)
        cosine = V.dot(F.col("force_n"), axis) / (V.norm(F.col("force_n")) * V.norm(axis))
        ok = ok & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= spec["cone_rad"])
    return ep.guarded("contact", _judge(rows, F.when(F.col("active"), ok).otherwise(F.when(~F.col("active"), F.lit(False)))))


def object_above_height(ep: Episode, spec: dict) -> DataFrame:
    """Absolute, or above the first present row of the whole run by delta_m; sustained, or at the end."""
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _pose(ep, spec, spec["entity"])
    if spec.get("delta_m") is not None:
        first = ep.tables["pose"].where((F.col("entity_id") == ep.entity(spec["entity"])) & F.col("position").isNotNull()).groupBy("run_id").agg(F.min_by(F.col("position")[2], "sample_index").alias("_z0"))
        rows = rows.join(first, "run_id")
        ok = F.col("position")[2] - F.col("_z0") >= ep.number(spec["delta_m"])
    else:
        ok = F.col("position")[2] >= ep.number(spec["height_m"])
    return ep.guarded("pose", _sustained(ep, rows, ok, float(spec.get("minimum_duration_s", 0.0)), True), late={S.REFUTED: "channel_incomplete"})


def _region(p: Column, region: dict) -> Column:
    from .boxes import inside_box, inside_sphere

    return inside_sphere(p, region["center"], region["radius"]) if region["type"] == "sphere" else inside_box(p, region["minimum"], region["maximum"])


def object_inside_region(ep: Episode, spec: dict) -> DataFrame:
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _pose(ep, spec, spec["entity"])
    return ep.guarded("pose", _sustained(ep, rows, _region(F.col("position"), spec["region"]), float(spec.get("minimum_duration_s", 0.0)), True), late={S.REFUTED: "channel_incomplete"})


def object_follows_frame_for_duration(ep: Episode, spec: dict) -> DataFrame:
    """The object's pose in the frame stays near an expected one, or near that of a segment's first sample."""
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _with_reference(ep, spec, _pose(ep, spec, spec["entity"]), spec["frame"])
    rel = rows.withColumn("_p", V.relative_position(F.col("ref_p"), F.col("ref_q"), F.col("position"))).withColumn("_q", V.relative_rotation(F.col("ref_q"), F.col("quaternion")))
    tol, turn, need = float(spec["position_tolerance"]), spec.get("rotation_tolerance"), float(spec["minimum_duration_s"])
    if spec.get("expected_position") is not None:
        ok = V.distance(F.col("_p"), V.vec(*spec["expected_position"])) <= tol
        if turn is not None:
            ok = ok & (V.angle(F.col("_q"), V.vec(*spec.get("expected_quaternion", (0, 0, 0, 1)))) <= turn)
        return ep.guarded("pose", _sustained(ep, rel, ok, need, False), continuous=True)

    def of(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("sample_index")
        t, p, q = pdf["time_s"].to_numpy(), np.stack(pdf["_p"].to_numpy()), np.stack(pdf["_q"].to_numpy())
        best = 0.0
        for i in range(len(t)):
            if t[-1] - t[i] <= best:
                break  # no later start can last longer
            last, step = i, 16
            while last == i or last + 1 < len(t):  # ever larger steps up to the first row that strays
                rows = slice(last, last + step)
                good = np.sqrt(((p[rows] - p[i]) ** 2).sum(1)) <= tol
                if turn is not None:
                    good &= 2 * np.arccos(np.minimum(1, np.abs((q[rows] * q[i]).sum(1)))) <= turn
                bad = np.flatnonzero(~good)
                if len(bad):
                    last += int(bad[0]) - 1
                    break
                last, step = last + len(good) - 1, 2 * step
                if len(good) < 2:
                    break
            best = max(best, t[max(last, i)] - t[i])
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "d": [float(best)]})

    best = rel.select("run_id", "sample_index", "time_s", "_p", "_q").groupBy("run_id").applyInPandas(of, f"run_id {ep.runs.schema['run_id'].dataType.simpleString()}, d double")
    return ep.guarded("pose", best.select("run_id", _verdict(F.col("d") >= need).alias("judged"), F.lit(None).cast("string").alias("why")), continuous=True)


def path_stayed_within_corridor(ep: Episode, spec: dict) -> DataFrame:
    channel = spec.get("channel", "pose")
    if channel not in ep.tables:
        return ep.guarded(channel, None)
    from .boxes import inside_box, inside_corridor

    c, p = spec["corridor"], F.col("position")
    ok = inside_corridor(p, c["points"], c["radius"]) if c["type"] == "polyline" else inside_box(p, c["minimum"], c["maximum"])
    judged = _pose(ep, spec, spec["entity"], channel).groupBy("run_id").agg(F.bool_and(ok).alias("o")).select("run_id", _verdict(F.col("o")).alias("judged"), F.lit(None).cast("string").alias("why"))
    return ep.guarded(channel, judged, continuous=True)


def inserted_to_depth(ep: Episode, spec: dict) -> DataFrame:
    """Signed depth of the object from the reference along a world axis, and what is left beside the axis."""
    if "pose" not in ep.tables:
        return ep.guarded("pose", None)
    rows = _terminal_pose(ep, spec)
    size = sum(x * x for x in spec["axis"]) ** 0.5
    axis = V.vec(*[x / size for x in spec["axis"]])
    d = V.sub(F.col("position"), F.col("ref_p"))
    depth = V.dot(d, axis)
    aside = V.norm(V.sub(d, V.scaled(axis, depth)))
    return ep.guarded("pose", _judge(rows, (depth >= spec["minimum_depth_m"]) & (aside <= spec["lateral_tolerance_m"])))


def deformable_keypoints_in_region(ep: Episode, spec: dict) -> DataFrame:
    if "deformable" not in ep.tables:
        return ep.guarded("deformable", None)
    rows = ep.rows("deformable", spec).where((F.col("entity_id") == ep.entity(spec["entity"])) & (F.size("keypoints") > 0))
    present = F.filter("keypoints", lambda k: k.isNotNull())
    share = F.size(F.filter(present, lambda k: _region(k, spec["region"]))) / F.size(present)
    need = float(spec.get("minimum_duration_s", 0.0))
    return ep.guarded("deformable", _sustained(ep, rows, share >= spec["minimum_fraction"], need, True), continuous=need > 0)


def deformable_shape_within_tolerance(ep: Episode, spec: dict) -> DataFrame:
    """Ordered root mean square and largest distance of the last sample's points from the expected ones; counts must agree."""
    if "deformable" not in ep.tables:
        return ep.guarded("deformable", None)
    rows = _terminal(ep.rows("deformable", spec).where(F.col("entity_id") == ep.entity(spec["entity"])), spec, [], ["keypoints"])
    expected = F.array(*[V.vec(*p) for p in spec["expected"]])
    d = F.zip_with("keypoints", expected, lambda a, b: V.distance(a, b))
    rms = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x) / len(spec["expected"]))
    ok = F.when(F.size("keypoints") == len(spec["expected"]), (rms <= spec["rmse_tolerance_m"]) & (F.array_max(d) <= spec.get("maximum_tolerance_m", float("inf"))))
    return ep.guarded("deformable", _judge(rows, ok))


LEAVES: dict[str, Callable[[Episode, dict], DataFrame]] = {f.__name__: f for f in (
    joint_within_tolerance, joint_position_in_range, joint_velocity_below_threshold, frame_within_pose_tolerance, base_reached_goal,
    frame_position_within_tolerance, frame_position_in_bounds, frame_velocity_below_threshold, collision_free_over_interval, contact_sustained,
    contact_force_at_terminal, object_above_height, object_inside_region, object_follows_frame_for_duration, path_stayed_within_corridor,
    inserted_to_depth, deformable_keypoints_in_region, deformable_shape_within_tolerance,
)}


def composite(spec: dict, statuses: dict[str, Column]) -> Column:
    """Status of a predicate over others' statuses; one that is not there yet is unknown."""
    of = lambda name: statuses.get(name, F.lit(S.UNKNOWN))
    if spec["type"] == "evidence_conjunction":
        return S.fold([of(n) for n in spec["predicates"]], S.ALL)
    if spec["type"] == "object_grasped":
        return S.fold([of(n) for n in [*spec["contacts"], *([spec["gripper"]] if spec.get("gripper") else []), spec["follows"], spec["lifted"]]], S.GRASP)
    if spec["type"] == "object_released_in_region":
        return S.release(of(spec["inside"]), of(spec["contact"]), of(spec["gripper"]) if spec.get("gripper") in statuses else None)
    raise ValueError(f"unknown predicate type {spec['type']}")


#: In three fixed passes: leaves, then grasp and release, then conjunctions, each in the order of the specification.
PASSES = (tuple(LEAVES), ("object_grasped", "object_released_in_region"), ("evidence_conjunction",))
