"""spanwright: a PySpark-native engine for agent trajectories and their telemetry."""
