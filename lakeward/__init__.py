"""Maintenance and analytics of log-structured lake tables on Spark."""
