"""Table operators: DataFrame in, DataFrame or gate result out."""
