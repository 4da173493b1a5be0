"""riskloom: card-fraud analytics written as Spark DataFrame jobs."""
