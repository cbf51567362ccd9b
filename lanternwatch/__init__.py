"""Analytics over AI-agent activity and text corpora as PySpark jobs."""
