"""All registered queries of the engine's own operators."""

from . import articulated, captures, described, episodes, geometry, knowledge, live, meaning, scenes, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
