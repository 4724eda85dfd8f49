"""Question-bank jobs on Spark: every public function takes and returns DataFrames or Columns."""
