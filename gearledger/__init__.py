"""Equipment-rental analytics as set-based Spark jobs."""
