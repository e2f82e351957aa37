"""Tidewater: decision-support queries and workload intelligence as Spark jobs."""
