"""Reads of date-keyed tables, calendars, universes, the security list, CSV output."""
