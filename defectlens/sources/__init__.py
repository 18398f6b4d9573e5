"""Sources and sinks: driver tables, CSV, JSON documents, versioned snapshots."""
