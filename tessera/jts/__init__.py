"""JVM kernels over geometries in WKB, on the JTS library that Spark ships."""
