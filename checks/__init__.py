"""Every report and operator on the generated test tables: ``registry`` runs it
with Spark, ``oracle`` computes the same with SQL in another engine."""
