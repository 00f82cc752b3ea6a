"""DataFrame operators: features, pairs, retrieval, ranking, serving, metrics, drift, telemetry."""
