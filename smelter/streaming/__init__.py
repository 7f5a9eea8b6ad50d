from .daily_fact import compact_fact, current_fact, refresh_fact_from_stream
from .first_rows import dedupe_stream, first_rows

__all__ = ["compact_fact", "current_fact", "dedupe_stream", "first_rows", "refresh_fact_from_stream"]
