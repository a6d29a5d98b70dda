"""notemill: note and table exports, formulas, links and rollups as Spark DataFrames."""
