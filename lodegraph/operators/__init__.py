"""Graph and version operators: DataFrame in, DataFrame out."""
