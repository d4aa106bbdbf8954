"""DataFrame operators: retrieval, chunking, merging, stores, telemetry, rate governing, heuristics, HTML, embedding."""
