"""gridloom: raster and attribute-table analytics as Spark DataFrame plans."""
