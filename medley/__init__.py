"""medley: a PySpark library for collections of items that belong to many groups."""
