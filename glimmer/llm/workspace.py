"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

from ..workspace import Workspace, shared_folder

__all__ = ["Workspace", "shared_folder"]
