"""factorlake: point-in-time factor research on large panels, as Spark jobs."""
