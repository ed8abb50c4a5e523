"""Intermediate tables of the operators, in the folder that driver and executors share."""

from lodestone.shared import Scratch, new_path, remove, shared_folder, staged

__all__ = ["Scratch", "new_path", "remove", "shared_folder", "staged"]
