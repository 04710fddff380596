"""Tables between two steps, in the folder that all executors share."""

from ledgerlark.plans.shared import new_path, removed, shared_folder, written

__all__ = ["new_path", "removed", "shared_folder", "written"]
