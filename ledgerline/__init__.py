"""Write-safety and audit analytics on Spark DataFrames."""
