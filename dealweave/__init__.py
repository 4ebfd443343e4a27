"""Deal-document and correspondence analytics as Spark DataFrame operators."""
