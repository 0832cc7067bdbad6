"""Structured Streaming counterparts of the keyed-state and roll-up operators."""

from sedimenta.streaming.events import deduplicated, ingest, latest_usage, rate_limited, run_once, sessions, windowed_counts

__all__ = ["deduplicated", "ingest", "latest_usage", "rate_limited", "run_once", "sessions", "windowed_counts"]
