"""weft: a property-graph analytics engine that compiles pattern queries to Spark DataFrame plans."""
