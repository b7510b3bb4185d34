"""Reading logs."""

from .logs import read_logs, write_raw
from .reader import LogSource, read_callback, read_until
from .split import read_split

__all__ = ["LogSource", "read_callback", "read_logs", "read_split", "read_until", "write_raw"]
