"""Physical helpers: lineage cutting and session settings."""

from lattix.plans.storage import clean, materialize, release, scratch_dir, shared_dir

__all__ = ["clean", "materialize", "release", "scratch_dir", "shared_dir"]
