"""Column expressions (JVM-side, codegen friendly) shared by the jobs."""
