"""Column helpers that keep one notion of a missing value: NULL, never NaN."""

from .columns import *  # noqa: F403
