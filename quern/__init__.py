"""quern: corpus curation, treebank analytics and training-data preparation on Spark."""
