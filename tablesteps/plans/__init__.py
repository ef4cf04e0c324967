"""Pipelines of named steps, the step log, templates and the query catalogue."""
