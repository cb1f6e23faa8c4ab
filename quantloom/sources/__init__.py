"""Readers with canonical names, and sinks."""

from .tables import *  # noqa: F403
