"""A Spark engine for OpenStreetMap elements: sources, row programs, sinks."""
