"""Readers and writers for the formats of historical grids, entity stores and event logs."""
