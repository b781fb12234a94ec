"""Readers and writers."""

from solvara.sources.files import *  # noqa: F403
