"""What the operators share with the rest of the library: scratch tables on shared storage, and the shipping of code."""

from __future__ import annotations

from filigree.runtime import ship  # noqa: F401
from filigree.sources.scratch import Scratch, shared_dir  # noqa: F401
