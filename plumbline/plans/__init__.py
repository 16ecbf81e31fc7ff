"""Fusing many metrics into few scans."""

from plumbline.plans.findings import Finding, findings_frame
from plumbline.plans.measures import Measures

__all__ = ["Finding", "Measures", "findings_frame"]
