"""millrace: record-data analytics expressed as Spark DataFrame transformations."""
