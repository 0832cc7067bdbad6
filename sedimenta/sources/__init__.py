"""Readers, writers and shared scratch storage."""

from sedimenta.sources.tables import clear_scratch, is_folder, load, materialize, scratch_dir

__all__ = ["clear_scratch", "is_folder", "load", "materialize", "scratch_dir"]
