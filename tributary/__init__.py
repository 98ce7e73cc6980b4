"""tributary: merging analyzer reports, and preparing text corpora, as Spark plans."""
