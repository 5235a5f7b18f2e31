"""tidemark: price-bar analytics and strategy research as Spark plans."""
