"""brindle: a relational analytics engine declared on Spark DataFrames and Spark SQL."""
