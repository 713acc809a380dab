"""Readers, the history store, landing files and gated sinks."""
