"""Incremental forms of batch aggregates. The classic programs read finite files only; this is an
extension for feeds that keep arriving."""
