"""graphloom: property-graph, text and vector analytics declared as Spark DataFrame plans."""

__version__ = "0.1.0"
