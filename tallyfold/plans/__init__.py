"""Workloads, registered queries and their SQL."""
