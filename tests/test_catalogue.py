"""Registered queries against their SQL on the smallest tables, where those are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ATTEST_DATA", "/root/testdata/sf0.001")
OWN = entry._own
NAMES = ["goal_expression", "asof_latest_observation", "carry_forward_snapshot", "completeness_status", "longest_sustained_run", "anchored_longest_segment", "status_fold_release", "truth_evaluation", "lifecycle_status", "post_execution_effect", "counterfactual_contribution", "tree_path", "affine_chain", "nation_components", "fk_chain", "tree_root_paths", "tree_descendants", "proof_closure", "keyed_diff", "set_equality", "aabb_overlap_pairs", "distance_threshold_pairs", "nearest_pair", "relative_pose", "keypoint_rmse", "wilson_interval", "prf1", "interval_overlap_join", "stream_gap_state", "corruption_out_of_order", "fact_retrieve", "inverted_index", "shape_classes", "stream_session", "joint_snapshots", "transform_issues", "action_capture_issues", "bundle_validation", "predicate_contact_sustained", "predicate_object_follows_frame_for_duration", "task_verdicts", "pose_resolution", "motion_causality", "articulation_compare", "graph_edits", "graph_edit_reports", "subtree_validation", "invariant_assertions", "scene_frames", "environment_collisions", "minimum_separation", "face_components", "configuration_atlas", "constraint_residuals", "summarize_action", "requirement_grounding", "suite_grading", "leak_scan", "edit_grading", "evidence_source_issues", "trace_import", "robot_joints", "geometric_jacobian", "channel_issue_rows"]


def text(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_registry():
    assert set(OWN.ORACLES) <= set(OWN.QUERIES) and len(OWN.QUERIES) > 220 and set(NAMES) <= set(OWN.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, tables, name):
    df = OWN.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    out = tables.execute(OWN.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    out = entry.entry(spark)
    assert out.columns == ["user_id", "goal", "verdict"] and out.count() > 0
