"""Event-triggered image-stack analytics expressed as Spark DataFrame plans."""
