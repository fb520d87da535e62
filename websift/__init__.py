"""websift: a web-search analytics engine on Spark DataFrames."""
