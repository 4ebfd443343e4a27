"""Query plans by family; importing this package fills the registry."""

from dealweave.plans import checklist, mail, records, redline, signing  # noqa: F401
