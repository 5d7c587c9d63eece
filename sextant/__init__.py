"""Search and analytics over code graphs and text corpora, as DataFrame and SQL plans."""
