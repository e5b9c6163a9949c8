"""Intermediate tables in the folder that all executors share."""

from inkstream.sources.staging import shared_folder, written

__all__ = ["shared_folder", "written"]
