"""cairn: registry search, harvesting and validation as Spark DataFrame operators."""
