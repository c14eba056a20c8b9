"""blockpipe: data pipelines from small linked blocks, on Spark.

Every block takes and returns lazy DataFrames; see ``operators`` (profile,
cleaning, transformation, combination), ``sources`` (reads, writes, moves,
snapshots), ``plans`` (SQL models, pipelines, lineage) and ``functions``
(column expressions).
"""

from blockpipe.functions import standardize_name
from blockpipe.operators import *  # noqa: F401,F403
from blockpipe.operators import __all__ as _ops
from blockpipe.plans import *  # noqa: F401,F403
from blockpipe.plans import __all__ as _plans
from blockpipe.session import checkpoint_root, get_session, scratch_path
from blockpipe.sources import *  # noqa: F401,F403
from blockpipe.sources import __all__ as _sources

__all__ = [*_ops, *_plans, *_sources, "standardize_name", "get_session", "checkpoint_root", "scratch_path"]
