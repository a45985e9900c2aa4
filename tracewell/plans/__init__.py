"""Every query of the engine by name."""

from . import batch, catalogue, imaging, spikes, views  # noqa: F401  (they register their queries)
from .registry import ENTRIES

QUERIES = {name: e.query for name, e in ENTRIES.items()}
ORACLES = {name: e.sql for name, e in ENTRIES.items() if e.sql}
