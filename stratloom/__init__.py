"""stratloom: block-model and corpus analytics expressed as Spark plans."""
