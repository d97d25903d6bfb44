"""strandloom: de Bruijn graphs over DNA k-mers as Spark DataFrames."""
