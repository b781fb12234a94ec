"""Column expressions."""

from solvara.functions.expr import *  # noqa: F403
from solvara.functions.topics import *  # noqa: F403
