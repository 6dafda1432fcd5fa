"""corundum: evidence extraction, linking and scoring as Spark DataFrame plans."""
