"""Readers and writers of feeds, panels, forecasts and parameters."""
