"""brindle: hybrid retrieval, text ETL and retrieval evaluation on Spark DataFrames."""
