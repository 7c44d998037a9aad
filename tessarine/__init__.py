"""Knowledge-graph analytics and corpus processing as Spark DataFrame plans."""
