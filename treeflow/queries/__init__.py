"""Queries: operators applied to the driver's tables through the lenses of treeflow.lens."""

from treeflow.queries import archive, events, functions, identity, reconcile, retention, streams, telemetry  # noqa: F401
