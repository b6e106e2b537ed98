"""prismlake: a Spark-first analytics engine for media catalogs."""
