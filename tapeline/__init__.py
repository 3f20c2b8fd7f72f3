"""Market analytics as Spark DataFrame operators over long-format tables."""
