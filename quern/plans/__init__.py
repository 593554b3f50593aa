"""Decisions made on the driver before a plan is built."""
