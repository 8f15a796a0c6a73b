"""tessera: raster, burst and tabular analytics expressed as Spark plans."""
