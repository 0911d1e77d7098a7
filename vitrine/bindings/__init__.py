"""Bindings of the generic operators to the driver's tables, with oracle SQL."""
