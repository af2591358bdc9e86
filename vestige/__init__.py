"""Forensic analytics over agent activity, as Spark DataFrame jobs."""
