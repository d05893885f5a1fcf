"""Where operators keep written tables; see :mod:`strandwise.workspace`."""

from strandwise.workspace import CHECKPOINT_KEY, Workspace, shared_dir

__all__ = ["CHECKPOINT_KEY", "Workspace", "shared_dir"]
