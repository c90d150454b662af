"""Evidence analytics over web-page snapshots, expressed as Spark plans."""
