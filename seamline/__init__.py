"""Series, array, point and interval analytics as Spark DataFrame programs."""
