"""provenlake: evidence, provenance and corpus analytics expressed as Spark jobs."""
