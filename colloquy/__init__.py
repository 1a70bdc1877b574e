"""Speaker-level concept graphs from group discussions, expressed as Spark plans."""
