"""smelter: from raw files to governed answers, on Spark."""

from . import functions, operators, plans, sources, streaming
from .plans.medallion import MedallionRun, build_gold, open_run, run_from_gold, run_medallion
from .session import local_session, shared_dir

__all__ = ["MedallionRun", "build_gold", "functions", "local_session", "open_run", "operators", "plans",
           "run_from_gold", "run_medallion",
           "shared_dir", "sources", "streaming"]
