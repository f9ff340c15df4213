"""Query plans: flagship slice, registered queries and batch jobs."""
