"""Table operators: DataFrame in, DataFrame or fitted model out."""
