"""Vision dataset construction as Spark DataFrame and SQL transformations."""
