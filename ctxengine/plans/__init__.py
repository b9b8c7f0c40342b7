"""Whole-session plans and the queries of the driver."""
