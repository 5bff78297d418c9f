"""chronolode: version-history analytics as Spark DataFrame plans."""
