"""fieldspan: typed, provenance-carrying tables from semi-structured documents, on Spark."""
