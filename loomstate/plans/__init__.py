"""Plans of state steps, effects, forks, selections and commits, run over any number of executions at once."""

from .plan import Plan, PlanError  # noqa: F401
from .run import Run  # noqa: F401
