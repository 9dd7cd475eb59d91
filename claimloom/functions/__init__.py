"""Column functions: everything here stays inside the JVM and composes into one projection."""
