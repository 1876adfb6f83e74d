"""DataFrame operators: joins, resolution, snapshots, telemetry, ranking."""
