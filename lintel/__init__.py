"""lintel: analytics over agent events, activity logs and source text, written as Spark DataFrame plans."""
