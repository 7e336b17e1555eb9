"""Sources and sinks of the engine."""

from fieldspan.sources.documents import from_files, read_results, write_inputs

__all__ = ["from_files", "read_results", "write_inputs"]
