"""Imports every family so that its queries are registered."""

from tidewatch.plans import detection, drift, evaluation, flow, ingest, learning, reports, rules, streams, windows  # noqa: F401
