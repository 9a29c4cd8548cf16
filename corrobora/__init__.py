"""Evidence analytics on Spark: record checking, review analytics and data preparation as DataFrame plans."""
