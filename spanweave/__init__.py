"""Search and analytics over entity-annotated text, written as Spark plans."""
