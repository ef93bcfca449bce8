"""Readers, contracts, adapters and sinks."""
