"""Physical-plan support: staged tables, measured broadcasts, hot-key splits."""

from knitgraph.plans.skew import Limits, heavy_keys, lookup
from knitgraph.plans.workspace import Staged, Workspace, checkpoint_root, workspace

__all__ = ["Limits", "Staged", "Workspace", "checkpoint_root", "heavy_keys", "lookup", "workspace"]
