"""Journey analytics on Spark: event logs in, state-transition models and scores out."""

from wayfare.sources.log import JourneyLog, open_log

__all__ = ["JourneyLog", "open_log"]
