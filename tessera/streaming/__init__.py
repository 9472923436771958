"""Structured Streaming: incremental builds, event windows and a stateful balancer."""
