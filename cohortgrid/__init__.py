"""cohortgrid: labelled sample-by-feature analytics expressed as Spark plans."""
