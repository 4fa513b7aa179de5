"""skerry: a PySpark engine for repository-metadata harvests and their analysis."""
