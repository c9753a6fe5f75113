"""Row rules on streams."""

from .monitor import file_stream, rule_counts, stream_violations

__all__ = ["file_stream", "rule_counts", "stream_violations"]
