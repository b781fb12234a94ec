"""Incremental forms of batch operators; each gives the rows of its batch form."""

from solvara.streaming.jobs import *  # noqa: F403
