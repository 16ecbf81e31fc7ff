"""The monitoring cycle, in batch and on streams, and quality per time window."""

from plumbline.streaming.monitor import Cycle, run_cycle, start_monitoring
from plumbline.streaming.windows import distinct_by_window, quality_by_window

__all__ = ["Cycle", "distinct_by_window", "quality_by_window", "run_cycle", "start_monitoring"]
