"""Column functions: vertex programs, priorities, statistics."""
