"""Process-quality analytics and event monitoring as Spark DataFrame operators."""
