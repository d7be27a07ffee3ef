"""Document analytics on Spark: pages, sections, sentences, citations and vectors as DataFrames."""
