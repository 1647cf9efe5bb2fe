"""Tables: schema definitions, generated and ingested data, indexes, statistics, and result sinks."""
