"""Where tables come from and where results go."""

from plumbline.sources.pinning import pin
from plumbline.sources.store import RunStore
from plumbline.sources.tables import from_pandas, read_table

__all__ = ["RunStore", "from_pandas", "pin", "read_table"]
