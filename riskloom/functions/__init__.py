"""Pure Column builders: no Spark action happens in this package."""
