"""Column-to-column building blocks; everything here stays inside the JVM unless a name says Arrow."""
