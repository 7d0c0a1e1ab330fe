"""Territorial analytics on Spark: accessibility, indices, matching, packing and cleaning as DataFrame plans."""
