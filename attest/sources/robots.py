"""Robot descriptions: XML documents to link, joint, geometry, inertial, actuation and group tables.

Documents are one row each (robot, xml) and are parsed on the executors in Arrow batches; every table is a DataFrame over
many robots. Formats: urdf, srdf, sdf and mjcf, told by the root element. A document that cannot be read, is a template
(holds the templating namespace) or has not exactly one root link is in `rejected` with its reason.
"""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = "robot string, link string"
JOINTS = "robot string, joint string, type string, parent string, child string, xyz array<double>, rpy array<double>, axis array<double>, lower double, upper double, effort double, velocity double, mimic_joint string, mimic_multiplier double, mimic_offset double"
GEOMETRIES = "robot string, link string, kind string, index int, type string, size array<double>, radius double, length double, uri string, xyz array<double>, rpy array<double>"
INERTIALS = "robot string, link string, mass double, ixx double, ixy double, ixz double, iyy double, iyz double, izz double, xyz array<double>, rpy array<double>"
ACTUATION = "robot string, system string, joint string, interface string, kind string"
GROUPS = "robot string, grp string, member_kind string, member string, tip string"


def detect(xml: str) -> str:
    """Format by root element: urdf, srdf, sdf, mjcf or unknown."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return "unknown"
    tag = root.tag.rsplit("}", 1)[-1]
    if tag == "robot":
        return "srdf" if root.find("group") is not None and root.find("link/inertial") is None and root.find("joint/parent") is None else "urdf"
    return {"sdf": "sdf", "mujoco": "mjcf"}.get(tag, "unknown")


def _numbers(text: str | None, default: tuple[float, ...]) -> list[float]:
    out = [float(x) for x in text.split()] if text else list(default)
    if not all(map(math.isfinite, out)):
        raise ValueError("a number is not finite")
    return out


def _origin(node) -> tuple[list[float], list[float]]:
    o = node.find("origin") if node is not None else None
    return (_numbers(o.get("xyz"), (0, 0, 0)), _numbers(o.get("rpy"), (0, 0, 0))) if o is not None else ([0.0] * 3, [0.0] * 3)


def _shape(g) -> dict:
    kind = next(iter(g)) if len(g) else None
    if kind is None:
        raise ValueError("a geometry is empty")
    size = kind.get("size") or kind.get("scale")
    return {"type": kind.tag, "size": _numbers(size, ()) if size else None, "radius": float(kind.get("radius")) if kind.get("radius") else None, "length": float(kind.get("length")) if kind.get("length") else None, "uri": kind.get("filename")}


def parse_urdf(robot: str, xml: str) -> dict[str, list[dict]]:
    """Tables of one document; raises ValueError with the reason."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ValueError("syntax") from e
    if "xacro" in xml and "http://www.ros.org/wiki/xacro" in xml and any("xacro" in x.tag for x in root.iter()):
        raise ValueError("template")
    out: dict[str, list[dict]] = {"links": [], "joints": [], "geometries": [], "inertials": [], "actuation": []}
    for link in root.findall("link"):
        name = link.get("name")
        out["links"].append({"robot": robot, "link": name})
        if (i := link.find("inertial")) is not None:
            xyz, rpy = _origin(i)
            t = i.find("inertia").attrib
            out["inertials"].append({"robot": robot, "link": name, "mass": float(i.find("mass").get("value")), **{k: float(t.get(k, 0)) for k in ("ixx", "ixy", "ixz", "iyy", "iyz", "izz")}, "xyz": xyz, "rpy": rpy})
        for kind in ("visual", "collision"):
            for k, g in enumerate(link.findall(kind)):
                xyz, rpy = _origin(g)
                out["geometries"].append({"robot": robot, "link": name, "kind": kind, "index": k, **_shape(g.find("geometry")), "xyz": xyz, "rpy": rpy})
    for j in root.findall("joint"):
        xyz, rpy = _origin(j)
        axis = _numbers(j.find("axis").get("xyz") if j.find("axis") is not None else None, (1, 0, 0))
        n = math.sqrt(sum(a * a for a in axis))
        if n <= 1e-12:
            raise ValueError("axis")
        limit, mimic = (dict(x.attrib) if (x := j.find(t)) is not None else {} for t in ("limit", "mimic"))
        number = lambda d, k, other=None: float(d[k]) if k in d else other
        out["joints"].append({"robot": robot, "joint": j.get("name"), "type": j.get("type"), "parent": j.find("parent").get("link"), "child": j.find("child").get("link"), "xyz": xyz, "rpy": rpy, "axis": [a / n for a in axis], **{k: number(limit, k) for k in ("lower", "upper", "effort", "velocity")}, "mimic_joint": mimic.get("joint"), "mimic_multiplier": number(mimic, "multiplier", 1.0 if mimic else None), "mimic_offset": number(mimic, "offset", 0.0 if mimic else None)})
    for system in root.findall("ros2_control"):
        for j in system.findall("joint"):
            for kind in ("command_interface", "state_interface"):
                out["actuation"] += [{"robot": robot, "system": system.get("name"), "joint": j.get("name"), "interface": x.get("name"), "kind": kind.split("_")[0]} for x in j.findall(kind)]
    for t in root.findall("transmission"):
        for j in t.findall("joint"):
            out["actuation"] += [{"robot": robot, "system": t.get("name"), "joint": j.get("name"), "interface": h.text, "kind": "transmission"} for h in j.findall("hardwareInterface")]
    names = [x["link"] for x in out["links"]]
    children = [x["child"] for x in out["joints"]]
    if len(set(names)) != len(names) or len({x["joint"] for x in out["joints"]}) != len(out["joints"]):
        raise ValueError("names repeat")
    if len(set(children)) != len(children):
        raise ValueError("several parents")
    if not set(children) | {x["parent"] for x in out["joints"]} <= set(names):
        raise ValueError("unknown link")
    if len(set(names) - set(children)) != 1:
        raise ValueError("roots")
    reach, front = set(), set(names) - set(children)
    while front:
        reach |= front
        front = {x["child"] for x in out["joints"] if x["parent"] in front} - reach
    if reach != set(names):
        raise ValueError("cycle")
    return out


def parse_mjcf(robot: str, xml: str) -> dict[str, list[dict]]:
    """Nested bodies as links and joints; angles in degrees unless the compiler says radian. Free bodies hang on `world`."""
    root = ET.fromstring(xml)
    compiler = root.find("compiler")
    turn = 1.0 if compiler is not None and compiler.get("angle") == "radian" else math.pi / 180
    out: dict[str, list[dict]] = {"links": [{"robot": robot, "link": "world"}], "joints": [], "geometries": [], "inertials": [], "actuation": []}

    def body(node, parent: str) -> None:
        name = node.get("name") or f"body{len(out['links'])}"
        out["links"].append({"robot": robot, "link": name})
        j = node.find("joint")
        kind = {"hinge": "revolute", "slide": "prismatic", None: "revolute"}.get(j.get("type"), "floating") if j is not None else "fixed"
        scale = turn if kind == "revolute" else 1.0
        limits = [x * scale for x in _numbers(j.get("range"), ())] if j is not None and j.get("range") else [None, None]
        axis = _numbers(j.get("axis"), (0, 0, 1)) if j is not None else [1.0, 0.0, 0.0]
        n = math.sqrt(sum(a * a for a in axis))
        euler = [x * turn for x in _numbers(node.get("euler"), (0, 0, 0))]
        out["joints"].append({"robot": robot, "joint": (j.get("name") if j is not None else None) or f"{name}_joint", "type": kind, "parent": parent, "child": name, "xyz": _numbers(node.get("pos"), (0, 0, 0)), "rpy": euler, "axis": [a / n for a in axis], "lower": limits[0], "upper": limits[1], "effort": None, "velocity": None, "mimic_joint": None, "mimic_multiplier": None, "mimic_offset": None})
        for k, g in enumerate(node.findall("geom")):
            size = _numbers(g.get("size"), ())
            out["geometries"].append({"robot": robot, "link": name, "kind": "collision", "index": k, "type": g.get("type", "sphere"), "size": size or None, "radius": size[0] if size else None, "length": 2 * size[1] if len(size) > 1 else None, "uri": g.get("mesh"), "xyz": _numbers(g.get("pos"), (0, 0, 0)), "rpy": [0.0] * 3})
        for x in node.findall("body"):
            body(x, name)

    for x in root.find("worldbody").findall("body"):
        body(x, "world")
    return out


def parse_sdf(robot: str, xml: str) -> dict[str, list[dict]]:
    """Links and joints of the first model; poses relative to the model are made relative to the parent link (rotations fixed-axis)."""
    import numpy as np

    def matrix(p) -> np.ndarray:
        x, y, z, r, q, w = p
        (cr, sr), (cq, sq), (cw, sw) = ((math.cos(a), math.sin(a)) for a in (r, q, w))
        return np.array([[cw * cq, cw * sq * sr - sw * cr, cw * sq * cr + sw * sr, x], [sw * cq, sw * sq * sr + cw * cr, sw * sq * cr - cw * sr, y], [-sq, cq * sr, cq * cr, z], [0, 0, 0, 1]])

    model = ET.fromstring(xml).find(".//model")
    out: dict[str, list[dict]] = {"links": [], "joints": [], "geometries": [], "inertials": [], "actuation": []}
    raw = {n.get("name"): (n.find("pose").text if n.find("pose") is not None else None, n.find("pose").get("relative_to") if n.find("pose") is not None else None) for t in ("link", "joint", "frame") for n in model.findall(t)}
    child_of = {j.get("name"): j.find("child").text.strip() for j in model.findall("joint")}

    def world(name: str | None, seen: tuple = ()) -> np.ndarray:
        if name in (None, "", "__model__", "world"):
            return np.eye(4)
        if name in seen:
            raise ValueError("cycle")
        text, base = raw[name]
        base = base if base else (child_of[name] if name in child_of else None)
        return world(base, (*seen, name)) @ matrix(_numbers(text, (0,) * 6))

    for n in model.findall("link"):
        out["links"].append({"robot": robot, "link": n.get("name")})
    for j in model.findall("joint"):
        parent, child = j.find("parent").text.strip(), child_of[j.get("name")]
        local = np.linalg.inv(world(parent)) @ world(j.get("name"))
        axis = j.find("axis")
        a = _numbers(axis.find("xyz").text, (0, 0, 1)) if axis is not None else [1.0, 0.0, 0.0]
        limit = axis.find("limit") if axis is not None else None
        number = lambda k: float(limit.find(k).text) if limit is not None and limit.find(k) is not None else None
        rpy = [math.atan2(local[2, 1], local[2, 2]), math.asin(max(-1.0, min(1.0, -local[2, 0]))), math.atan2(local[1, 0], local[0, 0])]
        out["joints"].append({"robot": robot, "joint": j.get("name"), "type": j.get("type"), "parent": parent, "child": child, "xyz": local[:3, 3].tolist(), "rpy": rpy, "axis": a, "lower": number("lower"), "upper": number("upper"), "effort": number("effort"), "velocity": number("velocity"), "mimic_joint": None, "mimic_multiplier": None, "mimic_offset": None})
    return out


def parse_srdf(robot: str, xml: str) -> dict[str, list[dict]]:
    """Groups (links, joints, chains, subgroups), named states and disabled pairs."""
    root = ET.fromstring(xml)
    out: dict[str, list[dict]] = {"groups": [], "states": [], "disabled": []}
    for g in root.findall("group"):
        for x in g:
            out["groups"].append({"robot": robot, "grp": g.get("name"), "member_kind": x.tag, "member": x.get("base_link") if x.tag == "chain" else x.get("name"), "tip": x.get("tip_link")})
    for s in root.findall("group_state"):
        out["states"] += [{"robot": robot, "grp": s.get("group"), "state": s.get("name"), "joint": j.get("name"), "value": float(j.get("value"))} for j in s.findall("joint")]
    out["disabled"] = [{"robot": robot, "a": min(p.get("link1"), p.get("link2")), "b": max(p.get("link1"), p.get("link2")), "reason": p.get("reason")} for p in root.findall("disable_collisions")]
    return out


PARSERS = {"urdf": parse_urdf, "mjcf": parse_mjcf, "sdf": parse_sdf}
SCHEMAS = {"links": LINKS, "joints": JOINTS, "geometries": GEOMETRIES, "inertials": INERTIALS, "actuation": ACTUATION}


def read_robots(documents: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """documents (robot, xml) of any format in PARSERS to tables, and the rejected (robot, why)."""

    def table(name: str, kinds: str):
        columns = [c.strip().split(" ")[0] for c in kinds.split(", ")]

        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for robot, xml in zip(pdf["robot"], pdf["xml"], strict=True):
                    try:
                        rows += PARSERS[detect(xml)](robot, xml)[name]
                    except (ValueError, KeyError, AttributeError, TypeError):
                        continue
                yield pd.DataFrame(rows, columns=columns)

        return documents.select("robot", "xml").mapInPandas(of, kinds)

    def why(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for robot, xml in zip(pdf["robot"], pdf["xml"], strict=True):
                try:
                    PARSERS[detect(xml)](robot, xml)
                except KeyError:
                    rows.append((robot, "format"))
                except (ValueError, AttributeError, TypeError) as e:
                    rows.append((robot, str(e) if isinstance(e, ValueError) and len(str(e)) < 40 else "content"))
            yield pd.DataFrame(rows, columns=["robot", "why"])

    return {n: table(n, k) for n, k in SCHEMAS.items()}, documents.select("robot", "xml").mapInPandas(why, "robot string, why string")


STATES = "robot string, grp string, state string, joint string, value double"
DISABLED = "robot string, a string, b string, reason string"


def read_semantics(documents: DataFrame) -> dict[str, DataFrame]:
    """SRDF documents (robot, xml) to groups, states and disabled pairs; documents that cannot be read give no rows."""

    def table(name: str, kinds: str):
        columns = [c.strip().split(" ")[0] for c in kinds.split(", ")]

        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for robot, xml in zip(pdf["robot"], pdf["xml"], strict=True):
                    try:
                        rows += parse_srdf(robot, xml)[name]
                    except (ET.ParseError, ValueError, TypeError, AttributeError):
                        continue
                yield pd.DataFrame(rows, columns=columns)

        return documents.select("robot", "xml").mapInPandas(of, kinds)

    return {"groups": table("groups", GROUPS), "states": table("states", STATES), "disabled": table("disabled", DISABLED)}


def expand_groups(groups: DataFrame, joints: DataFrame, paths: DataFrame) -> DataFrame:
    """(robot, grp, joint): members named, of chains (the joints below base on the way to tip) and of subgroups at any depth.

    paths (robot, link, path) are root paths of links.
    """
    inner = groups.where("member_kind = 'group'").select(F.concat_ws("/", "robot", "grp").alias("parent"), F.concat_ws("/", "robot", "member").alias("child"))
    names = groups.select(F.concat_ws("/", "robot", "grp").alias("node")).distinct()
    from ..operators.graphs import descendants

    under = descendants(inner, names).select(F.col("ancestor"), F.col("node"))
    named = groups.where("member_kind = 'joint'").select("robot", "grp", F.col("member").alias("joint"))
    linked = groups.where("member_kind = 'link'").join(joints.select("robot", F.col("child").alias("member"), "joint"), ["robot", "member"]).select("robot", "grp", "joint")
    chains = groups.where("member_kind = 'chain'").join(paths.select("robot", F.col("link").alias("tip"), "path"), ["robot", "tip"])
    below = chains.select("robot", "grp", F.explode(F.expr("slice(path, cast(array_position(path, member) as int) + 1, size(path))")).alias("child"))
    own = named.unionByName(linked).unionByName(below.join(joints.select("robot", "child", "joint"), ["robot", "child"]).select("robot", "grp", "joint"))
    out = own.withColumn("node", F.concat_ws("/", "robot", "grp")).join(under, "node")
    return out.select("robot", F.substring_index("ancestor", "/", -1).alias("grp"), "joint").distinct()


def mimic_edges(joints: DataFrame) -> DataFrame:
    """Joints as edges of the mimic forest: child, parent (null for a driver), multiplier, offset; names hold the robot."""
    name = lambda c: F.concat_ws("/", "robot", c)
    moving = joints.where("type not in ('fixed', 'floating')")
    return moving.select(name("joint").alias("child"), F.when(F.col("mimic_joint").isNotNull(), name("mimic_joint")).alias("parent"), F.coalesce("mimic_multiplier", F.lit(1.0)).alias("multiplier"), F.coalesce("mimic_offset", F.lit(0.0)).alias("offset"))


def link_edges(links: DataFrame, joints: DataFrame) -> DataFrame:
    """The kinematic tree as (child, parent) with the robot in the names."""
    name = lambda c: F.concat_ws("/", "robot", c)
    return links.select("robot", F.col("link").alias("child")).join(joints.select("robot", "child", "parent"), ["robot", "child"], "left").select(name("child").alias("child"), F.when(F.col("parent").isNotNull(), name("parent")).alias("parent"))
