"""A PySpark engine for collections of versioned, nested records."""
