"""An access-path query engine on PySpark."""
